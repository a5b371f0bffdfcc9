import io
import zipfile
from email.message import EmailMessage

import pandas as pd

from paperloom.plans import source_queries
from paperloom.sources import files, listings, parsers


def archive(**parts):
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for name, xml in parts.items():
            z.writestr(name.replace("__", "/").replace("_x", ".x"), xml)
    return packed.getvalue()


def binary(spark, rows):
    return spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")


def test_office_files_and_failures(spark):
    slide = '<s xmlns:a="urn:a"><a:p><a:r><a:t>{}</a:t></a:r><a:br/><a:r><a:t>end</a:t></a:r></a:p></s>'
    deck = archive(**{f"ppt__slides__slide{n}_xml": slide.format(n) for n in (1, 2, 10)})
    rows = parsers.parse_office(binary(spark, [("d.pptx", deck), ("bad.docx", b"no archive"), ("x.odp", deck)])).collect()
    assert [(r["part"], r["value"]) for r in rows if r["path"] == "d.pptx"] == [
        ("slide1", "1\nend"),
        ("slide2", "2\nend"),
        ("slide10", "10\nend"),
    ]
    failed = {r["path"]: r["error"] for r in rows if r["status"] == "failed"}
    assert set(failed) == {"bad.docx", "x.odp"} and all(failed.values())


def test_mail_prefers_plain_text_and_reports_failures(spark):
    mail = EmailMessage()
    mail["From"], mail["Subject"] = "Ann <a@x.org>", "Grüße"
    mail.set_content("plain")
    mail.add_alternative("<p>html</p>", subtype="html")
    rows = parsers.parse_email(binary(spark, [("a.eml", mail.as_bytes()), ("b.eml", b"")])).collect()
    good, bad = sorted(rows, key=lambda r: r["path"])
    assert (good["subject"], good["body"].strip(), good["recipient"], good["status"]) == ("Grüße", "plain", None, "success")
    assert bad["status"] == "failed" and "no mail headers" in bad["error"]


def test_scan_is_case_sensitive(spark, tmp_path):
    for name in ("a.txt", "b.TXT", "c.txt.bak", "noext"):
        (tmp_path / name).write_text("x")
    found = files.scan_by_extension(spark, str(tmp_path), [".txt"]).collect()
    assert [r["path"].rsplit("/", 1)[-1] for r in found] == ["a.txt"]


def test_listing_fields_and_changes(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "k int, m int")
    try:
        listings.select_fields(df, ["k", "m; drop"])
        raise AssertionError("accepted an unknown field")
    except ValueError:
        pass
    seen = spark.createDataFrame([(1, 5), (2, 4)], "k int, m int")
    got = {r["k"]: r["change"] for r in listings.incremental_sync(df, seen, "k", "m").collect()}
    assert got == {2: "changed", 3: "new"}


def test_a_table_of_one_file_is_packed_and_parsed_on_all_cores(spark, tables):
    cores = spark.sparkContext.defaultParallelism
    for query in (source_queries.parse_xlsx, source_queries.parse_email):
        assert query(tables).rdd.getNumPartitions() >= cores


def test_a_header_is_parsed_once(monkeypatch):
    asked = []
    get = EmailMessage.__getitem__
    monkeypatch.setattr(EmailMessage, "__getitem__", lambda self, name: (asked.append(name), get(self, name))[1])
    rows = next(parsers._mail_batches(iter([pd.DataFrame({"path": ["a"], "content": [b"From: a@b.c\nSubject: s\n\nhi\n"]})])))
    assert rows["sender"].tolist() == ["a@b.c"] and rows["recipient"].tolist() == [None]
    assert [asked.count(n) for n in ("from", "to", "subject", "date")] == [1, 1, 1, 1]
