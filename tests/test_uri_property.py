"""Property test: URI collapse and static filter against a plain-Python statement of
the same rules, on random URIs (brute force on a small generated fixture)."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loggraph.constants import STATIC_EXTENSIONS
from loggraph.functions.uri import is_static_asset, uri_prefix

SEG = st.one_of(
    st.text(alphabet="abcxyz", min_size=0, max_size=4),
    st.integers(0, 99999).map(str),
    st.uuids().map(str),
    st.uuids().map(lambda u: str(u).upper()),
    st.sampled_from(["*", "2024abc", "a.js", "logo.PNG", "f.tar.bz2", "data.json"]),
)
URI = st.builds(
    lambda segs, q, frag, abs_: ("http://h.example" if abs_ else "") + "/" + "/".join(segs)
    + (("?" + q) if q is not None else "") + (("#" + frag) if frag is not None else ""),
    st.lists(SEG, min_size=0, max_size=5),
    st.one_of(st.none(), st.text(alphabet="a=1&/", max_size=6)),
    st.one_of(st.none(), st.text(alphabet="top/", max_size=4)),
    st.booleans(),
)


def py_prefix(uri: str) -> str:
    s = re.sub(r"\?.*$", "", uri, count=1)
    s = re.sub(r"#.*$", "", s, count=1)
    s = re.sub(r"/[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "/*", s)
    s = re.sub(r"/\d+", "/*", s)
    s = re.sub(r"(/\*)+", "/*", s)
    m = re.match(r"^((?:/[^/]*){1,2})", s)
    return m.group(1) if m else uri


def py_static(uri: str) -> bool:
    return re.search(r"(?i)\.(" + "|".join(STATIC_EXTENSIONS) + r")(\?.*)?$", uri) is not None


@settings(max_examples=1, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(URI, min_size=300, max_size=300))
def test_uri_rules_match_python(spark, uris):
    df = spark.createDataFrame([(u,) for u in uris], "uri string")
    got = {r.uri: (r.p, r.s) for r in df.select("uri", uri_prefix("uri").alias("p"),
                                                 is_static_asset("uri").alias("s")).collect()}
    for u in uris:
        assert got[u] == (py_prefix(u), py_static(u)), u
