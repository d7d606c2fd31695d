"""The automaton against a plain matcher, and the rules on odd URLs."""

import random
import re

import pytest

from lexigraph.llm import registry, urlglobs

BASE = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
URLS = [
    None, "", "no scheme/en/", "http://", "http://net", "http://NET/", "https://a.net/x", "https://anet/x", "https://example.net/en/1", "https://a.Example.NET/en/", "https://example.net/en", "https://badexample.net/en/1",
    "http://example.com/de/?x=.net/", "http://x.example.com/de", "http://x.org/fr/#top", "http://x.org?/fr/", "http://x.org#/fr/", "ftp://a://b.net/c", "http://a/b.net/x#://", "http://ünï.net/é", "http://x.org/\n/fr/",
    "http://free-bets.example.org/en/1", "http://free-bets.example.org/fr/1", "http://x.org/a.zip", "http://x.org/a?sessionid=4", "http://x.org/WP-login.php", "http://x.org/wp-login.php", "://net/", "http://net:80/", "http://" + "a." * 3000 + "net/" + "p" * 200_000,
]


def brute(url):
    """(host, path, rule, action) of the base rules, by the definition."""
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(h + p, a) for a, h, p in BASE if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits, key=lambda x: len(x[0])) if fits else (None, None)))


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, u, "block", 3) for i, u in enumerate(URLS)] + [(6, URLS[6], "again", 1), (None, URLS[8], None, None)]
    return spark.createDataFrame(rows, "page_id long, url string, rule string, tier int")


def plain(glob, text):
    """A glob by a regular expression."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if c == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 1
        elif end > 0:
            out, i = out + "[" + glob[i + 1 : end].replace("\\", r"\\").replace("!", "^", 1 if glob[i + 1] == "!" else 0) + "]", end
        else:
            out += {"*": ".*", "?": "."}.get(c, re.escape(c))
        i += 1
    return re.fullmatch(out, text, re.S) is not None


def test_automaton_against_regular_expressions():
    import numpy as np

    r = random.Random(11)
    globs = ["".join(r.choice(["a", "b", "*", "?", "[ab]", "[!a]", "[a-c]", "\\*", "c", "**"]) for _ in range(r.randrange(0, 14))) for _ in range(150)]
    texts = ["".join(r.choice("abc*") for _ in range(r.randrange(0, 18))) for _ in range(400)] + ["", "a" * 300]
    a = urlglobs.Automaton(globs)
    assert a.words > 8
    raw = [t.encode() for t in texts]
    sizes = np.array(list(map(len, raw)))
    got = a.find(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes) - sizes, sizes)
    for t, k in zip(texts, got, strict=True):
        assert k == next((i for i, g in enumerate(globs) if plain(g, t)), len(globs)), t


def test_base_rules_by_definition(pages):
    rows = urlglobs.judge(pages, list(urlglobs.SITES)).collect()
    assert len(rows) == len(URLS) + 2
    for r in rows:
        url = URLS[8] if r["id"] is None else URLS[r["id"]]
        host, path, rule, action = brute(url)
        assert (r["host"], r["path"], r["rule"], r["action"]) == (host, path, rule, action or "allow"), url


def test_method_decides_where_no_base_rule_does(pages):
    got = {r["id"]: (r["rule"], r["tier"], r["action"]) for r in urlglobs.judge(pages, [*urlglobs.SITES, *urlglobs.WORDS]).collect()}
    at = {u: i for i, u in enumerate(URLS)}
    assert got[at["http://free-bets.example.org/en/1"]] == ("host:free-bets", 1, "block")
    assert got[at["http://free-bets.example.org/fr/1"]] == ("org/fr/", 0, "allow")
    assert got[at["http://x.org/a.zip"]][2] == got[at["http://x.org/a?sessionid=4"]][2] == got[at["http://x.org/wp-login.php"]][2] == "block"
    assert got[0] == (None, None, "allow")


def test_rules_in_blocks_and_empty_inputs(pages, monkeypatch):
    rules = [*urlglobs.SITES, *urlglobs.WORDS]
    once = urlglobs.judge(pages, rules).collect()
    monkeypatch.setattr(urlglobs, "MASK_BYTES", 2000)
    assert len(urlglobs.compiled(rules)[1]) > 3
    assert sorted(map(str, urlglobs.judge(pages, rules).collect())) == sorted(map(str, once))
    assert urlglobs.judge(pages.where("false"), rules).count() == 0
    assert {r["action"] for r in urlglobs.judge(pages, []).collect()} == {"allow"}


def test_query_equals_its_sql(spark, tmp_path):
    import duckdb

    rows = [(i, u, "x") for i, u in enumerate(URLS[:-1])] + [(None, URLS[6], None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"file://{tmp_path}/pages.parquet")
    df = urlglobs.op11_url_filter(spark, f"file://{tmp_path}")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    cur = con.execute(registry.oracle_sql()["op11_url_filter"])
    assert [c[0] for c in cur.description] == df.columns
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, cur.fetchall()))
