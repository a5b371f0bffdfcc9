"""Column builders for references between pages: parts, resolution, canonical form (RFC 3986)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the parts of a reference. Groups 1, 3, 5, 6 and 8 keep their delimiters, so an
# empty part differs from a missing one.
REFERENCE = r"^(([A-Za-z][A-Za-z0-9+.-]*):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"
PARTS = {"scheme": 1, "authority": 3, "path": 5, "query": 6, "fragment": 8}
# Ports that a scheme has anyway.
DEFAULT_PORTS = {"http:": 80, "https:": 443}


def parts(reference: Column) -> dict[str, Column]:
    return {name: F.regexp_extract(reference, REFERENCE, group) for name, group in PARTS.items()}


def without_dots(path: Column) -> Column:
    """``.`` and ``..`` segments resolved; none goes above the first segment."""
    rooted = F.startswith(path, F.lit("/"))
    segments = F.split(path, "/")
    last = F.element_at(segments, -1)
    named = F.when(rooted, F.slice(segments, F.lit(2), F.size(segments))).otherwise(segments)
    none = F.array().cast("array<string>")

    def step(kept: Column, segment: Column) -> Column:
        up = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(segment == ".", kept).when(segment == "..", up).otherwise(F.concat(kept, F.array(segment)))

    kept = F.aggregate(named, none, step)
    kept = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    joined = F.concat(F.when(rooted, F.lit("/")).otherwise(F.lit("")), F.array_join(kept, "/"))
    return F.when(F.contains(path, F.lit(".")), joined).otherwise(path)


def resolve(base: Column, reference: Column) -> Column:
    """The target of a reference found at ``base``, fragment included; strict, as in section 5.2."""
    b, r = parts(base), parts(reference)
    absolute = r["scheme"] != ""
    placed = absolute | (r["authority"] != "")
    folder = F.when((b["authority"] != "") & (b["path"] == ""), F.lit("/")).otherwise(F.regexp_extract(b["path"], "^(.*/)?", 0))
    path = (
        F.when(placed | F.startswith(r["path"], F.lit("/")), without_dots(r["path"]))
        .when(r["path"] == "", b["path"])
        .otherwise(without_dots(F.concat(folder, r["path"])))
    )
    return F.concat(
        F.when(absolute, r["scheme"]).otherwise(b["scheme"]),
        F.when(placed, r["authority"]).otherwise(b["authority"]),
        path,
        F.when(placed | (r["path"] != "") | (r["query"] != ""), r["query"]).otherwise(b["query"]),
        r["fragment"],
    )


def canonical(url: Column) -> Column:
    """One spelling for a page: scheme and host in lower case, no default port, no fragment, a path."""
    p = parts(url)
    scheme = F.lower(p["scheme"])
    user = F.regexp_extract(p["authority"], "^(//.*@)?", 0)
    host = F.lower(F.substr(p["authority"], F.length(user) + 1))
    for name, port in DEFAULT_PORTS.items():
        host = F.when(scheme == name, F.regexp_replace(host, f":{port}$", "")).otherwise(host)
    host = F.regexp_replace(host, ":$", "")
    path = F.when((p["authority"] != "") & (p["path"] == ""), F.lit("/")).otherwise(without_dots(p["path"]))
    return F.concat(scheme, user, host, path, p["query"])
