"""Notes: scanning, passages, search, replacements, the index. Invariants on folders built here."""

import random

import pytest
import yaml
from pyspark.sql import functions as F

from tidepool.functions import text as X
from tidepool.operators import lineage, ranking
from tidepool.operators.chunking import split_body
from tidepool.operators.index import VectorIndex
from tidepool.operators.provider import HashingProvider, LoopbackProvider
from tidepool.plans import search as S
from tidepool.sources.notes import listing, read_notes, scalar, stored_notes, strings


class Controlled:
    """Three dimensions: what's about one subject, and all else."""

    default_min_score = 0.45

    def __init__(self):
        self.version, self.offline = "1", False

    def profile(self, refresh=False):
        return {"provider": "test", "version": self.version}

    def embed(self, texts, query=False):
        if self.offline:
            raise ValueError("offline")
        return [[1.0, 0.0, 0.0] if "sqlite" in t.lower() or "writers waiting" in t.lower() else [0.0, 1.0, 0.0] for t in texts]


def note(root, name, text, **meta):
    p = root / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(f"---\n{yaml.safe_dump(meta, allow_unicode=True)}---\n{text}", encoding="utf-8")
    return p


@pytest.fixture
def vault(tmp_path):
    root = tmp_path / "vault"
    root.mkdir()
    return root


def find(spark, vault, query, provider=None, index=None, **options):
    return S.search(spark, str(vault), S.Request(query, **({"mode": "fts"} | options)), provider, index)


def paths(out):
    return [r["path"] for r in out["results"]]


def codes(out):
    return [d["code"] for d in out["diagnostics"]]


def test_scan_and_quarantine(spark, vault):
    note(vault, "a.md", "# Top\ntext", title="A")
    note(vault, "_under.md", "x")
    note(vault, "UP.MD", "x")
    note(vault, "Attachments/in.md", "x")
    note(vault, ".obsidian/in.md", "x")
    note(vault, "pic.assets/in.md", "x")
    (vault / "bad.md").write_text("---\na: [\n---\n")
    (vault / "open.md").write_text("---\na: 1\n")
    (vault / "link.md").symlink_to(vault / "a.md")
    assert listing(str(vault)) == ["UP.MD", "_under.md", "a.md", "bad.md", "open.md"]
    assert "Attachments/in.md" in listing(str(vault), True)
    notes, skipped = read_notes(spark, str(vault))
    assert {r["path"] for r in notes.collect()} == {"a.md", "_under.md", "UP.MD"}
    assert {r["path"] for r in skipped.collect()} == {"bad.md", "open.md"}
    assert read_notes(spark, str(vault), max_bytes=5)[0].count() == 0


def test_coercion():
    assert strings(None) == [] and strings(True) == ["True"] and strings([1, None, {"a": 1}, "b"]) == ["1", "b"]
    assert scalar(["a"]) == "a" and scalar(["a", "b"]) == ""


def test_passages_cover_lines_and_respect_fences():
    body = "# One\n" + "".join(f"line {i} with some words\n" for i in range(350)) + "## Two\n```\n# not a heading\n~~~\n```\n> # Quoted\nend\n"
    lines = body.splitlines(keepends=True)
    parts = split_body(body)
    assert all("".join(lines[p.start - 1 : p.end]) == p.text for p in parts)
    assert all(len(p.text) <= 1600 + 200 for p in parts)
    assert [p.heading for p in parts if p.heading != "One"] == ["Two", "Quoted"]
    assert split_body("x" * 5000)[1].text == "x" * 1600
    assert [p.text for p in split_body(" \n")] == [""]


def test_tokens(spark):
    rows = spark.createDataFrame([("the src/db.py a_b café 数据库 锁",)], "t string")
    got = rows.select(X.tokens(F.col("t"), expand=True).alias("x")).first()["x"]
    assert {"src/db.py", "src", "db", "py", "a_b", "caf", "数据", "据库", "锁", "sqlite", "lock"} <= set(got) and "the" not in got
    assert set(X.query_terms("the src/db.py a_b café 数据库 锁")) == set(got)


@pytest.mark.parametrize(("pattern", "path", "hit"), [("src/**/*.py", "src/db.py", True), ("src/**/*.py", "src/a/b.py", True), ("src/*.py", "src/a/b.py", False), ("a?c", "abc", True), ("**", "x/y", True), ("a.c", "abc", False), ("src/*.py", "./src\\x.py", True)])
def test_globs(spark, pattern, path, hit):
    assert spark.createDataFrame([(path,)], "p string").select(X.glob_matches(pattern, F.col("p")).alias("x")).first()["x"] is hit


@pytest.mark.parametrize(("link", "target"), [("[[A/b|c#d]]", "A/b"), ("[x](a%20b.md#h)", "a b.md"), ("[x](a+b.md)", "a+b.md"), ("https://x.y/z", None), ("/abs.md", None), ("", None), ("plain.md", "plain.md"), ("100%.md", "100%.md"), ("a%2fb%zz%4", "a/b%zz%4"), ("%E6%95%B0.md", "数.md"), ("[x](%ff.md)", "\ufffd.md")])
def test_link_targets(spark, link, target):
    assert spark.createDataFrame([(link,)], "l string").select(X.link_target(F.col("l")).alias("x")).first()["x"] == target


def test_filter_before_limit(spark, vault):
    for i in range(8):
        note(vault, f"Lessons/o{i}.md", "retry retry retry", type="lesson", project="other", status="active")
    note(vault, "Lessons/mine.md", "retry", type="lesson", project="mine", status="active")
    note(vault, "Lessons/draft.md", "retry", type="lesson", project="mine", status="draft")
    note(vault, "plain.md", "retry")
    note(vault, "Lessons/all.md", "retry once", type="lesson", project="global", status="active")
    out = find(spark, vault, "retry", recall=True, project="mine", limit=2)
    assert sorted(paths(out)) == ["Lessons/all.md", "Lessons/mine.md"]
    with pytest.raises(ValueError, match="Recall"):
        S.Request("x", recall=True)


def test_chains(spark, vault):
    note(vault, "Lessons/old.md", "ancient wording", type="lesson", project="p", status="superseded", superseded_by="[[Lessons/middle]]")
    note(vault, "Lessons/middle.md", "between", type="lesson", project="p", status="superseded", superseded_by="[[new]]")
    note(vault, "Lessons/new.md", "current", type="lesson", project="p", status="active")
    out = find(spark, vault, "ancient wording", recall=True, project="p")
    assert paths(out) == ["Lessons/new.md"] and out["results"][0]["replacement_chains"] == [["Lessons/old.md", "Lessons/middle.md"]]
    note(vault, "Lessons/x.md", "ringwords", type="lesson", project="p", status="superseded", superseded_by="[[y]]")
    note(vault, "Lessons/y.md", "other", type="lesson", project="p", status="superseded", superseded_by="[[x]]")
    assert codes(find(spark, vault, "ringwords", recall=True, project="p")) == ["replacement_cycle"]
    note(vault, "Lessons/z.md", "lostwords", type="lesson", project="p", status="superseded", superseded_by="[[nowhere]]")
    assert codes(find(spark, vault, "lostwords", recall=True, project="p")) == ["replacement_missing"]


def test_follow_against_walks(spark):
    r = random.Random(1)
    nxt = {i: r.choice([None, *range(60)]) for i in range(60)}
    ends = {i for i in nxt if r.random() < 0.3}
    rows = [(i, i not in ends, nxt[i]) for i in nxt]
    got = {x["node"]: x for x in lineage.follow(spark.createDataFrame(rows, "node int, superseded boolean, next int")).collect()}
    for i in nxt:
        chain, at = [], i
        while at is not None and at not in ends and at not in chain:
            chain.append(at)
            at = nxt[at]
        if at in ends:
            assert (got[i]["target"], got[i]["chain"], got[i]["problem"]) == (at, chain, None)
        else:
            assert got[i]["target"] is None and got[i]["problem"] == ("replacement_missing" if at is None else "replacement_cycle")


def test_resolution_of_names(spark):
    """An exact path before names; a name only where one note alone has it, as stem or title."""
    notes = spark.createDataFrame([("a/x.md", "x", "Title"), ("b/x.md", "x", "Other"), ("c.md", "c", "c"), ("d.md", "d", "Same"), ("e.md", "e", "Same"), ("f.md", "f", "g"), ("g.md", "g", "h"), ("n.md", "n", None)], "path string, stem string, title string")
    want = {("a", "x"): "a/x.md", ("", "x"): None, ("", "x.md"): None, ("", "Title"): "a/x.md", ("", "c"): "c.md", ("", "Same"): None, ("", "g"): "g.md", ("z", "f"): "f.md", ("z", "h"): "g.md", ("", "none"): None, ("z", "b/x"): "b/x.md"}
    links = spark.createDataFrame([(i, *k) for i, k in enumerate(want)], "node int, folder string, target string")
    assert {r["node"]: r["next"] for r in lineage.resolve(links, notes).collect()} == dict(enumerate(want.values()))


def test_ranks_over_many_steps(spark):
    r = random.Random(4)
    rows = [(f"p{i:03}", round(r.uniform(-2, 9), r.choice([0, 1, 6]))) for i in range(400)]
    got = {x["path"]: x["rank"] for x in ranking.ranked(spark.createDataFrame(rows, "path string, score double")).collect()}
    assert got == {p: n for n, (p, _) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])), 1)}


def test_index_is_incremental_and_all_or_nothing(spark, vault, tmp_path):
    provider, index = Controlled(), VectorIndex(spark, str(tmp_path / "cache"))
    note(vault, "a.md", "SQLite locks")
    b = note(vault, "b.md", "pancakes")
    assert S.refresh_index(spark, str(vault), provider, index)["embedded_chunks"] == 2
    again = S.refresh_index(spark, str(vault), provider, index)
    assert (again["embedded_chunks"], again["reused_chunks"]) == (0, 2)
    out = find(spark, vault, "writers waiting", provider, index, mode="semantic")
    assert paths(out) == ["a.md"] and out["coverage"]["fresh_chunks"] == 2
    b.write_text("sqlite now")
    out = find(spark, vault, "writers waiting", provider, index, mode="semantic")
    assert paths(out) == ["a.md"] and "partial_index" in codes(out) and out["coverage"]["changed_notes"] == 1
    state = lambda: sorted((x.name, x.read_bytes()) for x in (tmp_path / "cache").rglob("*.json"))
    before = state()
    provider.offline = True
    with pytest.raises(Exception, match="offline"):
        S.refresh_index(spark, str(vault), provider, index)
    assert state() == before
    out = find(spark, vault, "sqlite", provider, index, mode="hybrid")
    assert "semantic_unavailable" in codes(out) and paths(out)
    provider.offline = False
    b.unlink()
    assert S.refresh_index(spark, str(vault), provider, index)["removed_notes"] == 1


def test_hybrid_and_evaluation(spark, vault, tmp_path):
    provider, index = HashingProvider(), VectorIndex(spark, str(tmp_path / "cache"))
    note(vault, "db.md", "sqlite busy timeout for writers", title="Database")
    note(vault, "web.md", "http retries and idempotency keys", title="Web")
    S.refresh_index(spark, str(vault), provider, index)
    out = find(spark, vault, "sqlite busy timeout", provider, index, mode="hybrid")
    top = out["results"][0]
    assert top["path"] == "db.md" and top["matched_by"] == ["fts", "semantic"] and top["score"] == round(2 / 61, 6)
    cases = [{"query": "sqlite timeout", "expected_paths": ["db.md"], "forbidden_paths": ["web.md"]}, {"query": "sqlite", "folder": "none", "expect_empty": True}, {"query": "http retries", "expected_paths": ["db.md"]}]
    report = S.evaluate(spark, str(vault), cases, provider, index, "fts")
    assert [c["passed"] for c in report["cases"]] == [True, True, False] and report["passed"] == 2 and report["recall_at_3"] == 0.5


def test_vectors(spark):
    rows = [([3.0, 4.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), ([float("inf"), 1.0],), ([1.0],), ([],), (None,)]
    d = spark.createDataFrame(rows, "v array<double>")
    assert [r[0] for r in d.select(ranking.valid_vector(F.col("v"), 2)).collect()] == [True] + [False] * 6
    assert d.limit(1).select(ranking.normalised(F.col("v"))).first()[0] == [0.6, 0.8]


@pytest.mark.parametrize("endpoint", ["http://example.com:11434", "ftp://127.0.0.1", "http://u:p@127.0.0.1", "http://127.0.0.1/x"])
def test_remote_endpoints_are_refused(endpoint):
    with pytest.raises(ValueError, match="loopback"):
        LoopbackProvider(endpoint, "m")


def test_stored_notes_are_those_of_the_source(spark, vault):
    """Spark's reader of binary files finds what the source of notes finds, but for names with an underscore before them."""
    for path in ("a.md", "Lessons/b.MD", "deep/er/c.md", ".hidden/d.md", "x.assets/e.md", "Attachments/f.md", "node_modules/g.md", "h.txt", "deep/.i.md"):
        note(vault, path, f"text of {path}", title=f"T {path}", tags=["x", 3])
    note(vault, "big.md", "x" * 5000)
    (vault / "broken.md").write_text("---\ntitle: a\n")
    (vault / "bytes.md").write_bytes(b"\xff\xfe")
    for attachments in (False, True):
        one, two = (f(spark, str(vault), max_bytes=4000, include_attachments=attachments) for f in (read_notes, stored_notes))
        columns = [c for c in two[0].columns if c != "absolute"]
        rows = lambda d, c: sorted(map(str, d.select(*c).collect()))
        assert rows(one[0], columns) == rows(two[0], columns) and one[0].count() == 3 + attachments
        assert sorted(r["path"] for r in one[1].collect()) == sorted(r["path"] for r in two[1].collect()) == ["big.md", "broken.md", "bytes.md"]
    plan = stored_notes(spark, str(vault), max_bytes=4000)[0]._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,4000)" in plan


def test_freshness_is_a_join_on_digests(spark, vault):
    note(vault, "a.md", "one")
    b, c = note(vault, "b.md", "two"), note(vault, "c.md", "three")
    corpus = S.Corpus(spark, str(vault))
    try:
        corpus.notes.count()
        b.write_text("else")
        c.unlink()
        assert corpus.unchanged(["a.md", "b.md", "c.md", "none.md"]) == {"a.md"}
    finally:
        corpus.release()
