"""The pipeline's stages one by one, and the entry without the subpackage."""

import os
import subprocess
import sys

import corpus_pipeline
from samples import SMALL, awkward, empty

import __spark_entry__ as entry
from paperloom.llm.decontaminate import contamination
from paperloom.llm.ngram_join import joined_documents
from paperloom.llm.quality import quality_scores
from paperloom.llm.secrets import secret_spans
from paperloom.storage import materialize


def test_every_operator_has_one_query():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()


def test_stages_decide_as_their_operators(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels, items = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("labels", "benchmark"))
    columns = docs.columns
    outputs = {}
    for name, stage in corpus_pipeline.STAGES:
        outputs[name] = docs, (docs := materialize(stage(spark, docs, SMALL)))
    assert all(out.columns == columns for _, out in list(outputs.values())[:-1])
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    before, after = outputs["quality classifier"]
    assert ids(after) == ids(quality_scores(before, labels).where("predicted = 1"))
    before, after = outputs["n-gram Jaccard join"]
    assert ids(after) == ids(joined_documents(before).where("doc_id = component_id"))
    before, after = outputs["benchmark decontamination"]
    assert ids(after) == ids(contamination(before, items).where("not contaminated"))
    before, after = outputs["secret scans"]
    assert ids(after) == ids(before)
    assert secret_spans(after).where("spans <> ''").count() == 0
    assert after.where("n_chars <> length(text)").count() == 0
    before, after = outputs["best-fit packing"]
    assert ids(after.where("piece = 0")) == ids(before)
    whole = corpus_pipeline.run(spark, SMALL).drop("sequence_id", "offset")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, after.drop("sequence_id", "offset").collect()))


def test_stages_take_awkward_and_empty_tables(spark):
    for docs in (awkward(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, SMALL))
    assert docs.count() == 0


def test_entry_without_the_subpackage(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for name in os.listdir(root):
        if name not in ("paperloom", "corpus_pipeline.py", ".git", "__pycache__"):
            (tmp_path / name).symlink_to(f"{root}/{name}")
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text(open(f"{root}/__spark_entry__.py").read())
    (tmp_path / "paperloom").mkdir()
    for name in os.listdir(f"{root}/paperloom"):
        if name not in ("llm", "__pycache__"):
            (tmp_path / "paperloom" / name).symlink_to(f"{root}/paperloom/{name}")
    code = "import __spark_entry__ as e; assert len(e.queries()) >= 98 and not [n for n in e.queries() if n.startswith('op1')]"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})


def test_workers_need_no_install(tmp_path):
    """All operators and the pipeline where the workers cannot import the package."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    code = f"""
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
def lacks(batches):
    import importlib.util
    import pyarrow as pa
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([importlib.util.find_spec("paperloom") is None])], ["lacks"])
assert spark.range(1).mapInArrow(lacks, "lacks boolean").head()["lacks"]
for name, query in entry.queries().items():
    if name.startswith("op") or name == "pipeline":
        assert query(spark, {SMALL!r}).count(), name
"""
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env=environment)
