"""A table of globs against a table of paths: the pairs are those of matching each with each."""

import itertools
import random
import re

from tidepool.functions import text as X


def test_pairs_are_those_of_each_with_each(spark):
    r = random.Random(1)
    names = ["src", "lib", "a", "b.c", "main.py", "x.test.py", "README.md", "é", ".hid", "v1"]
    paths = sorted({"/".join(r.choice(names) for _ in range(r.randint(1, 5))) for _ in range(150)} | {"./src/a", "src\\lib\\main.py", "", "/abs/x.md", "src/"})
    made = {"".join(r.choice(["src/", "lib/", "**/", "*", "?", "main.py", ".py", "a", "*.md", "**", "x.*.py", "(", "+"]) for _ in range(r.randint(1, 4))) for _ in range(300)}
    globs = sorted(made | {"**", "*", "", "src\\*", "src/lib/main.py", "**/*.md", "*/", "a?*"})
    got = {(x["path"], x["glob"]) for x in X.glob_pairs(spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame([(g,) for g in globs], "glob string")).collect()}
    clean = lambda p: re.sub(r"^\./", "", p.replace("\\", "/"))
    want = {(p, g) for p, g in itertools.product(paths, globs) if re.fullmatch(X.glob_regex(g), clean(p))}
    assert got == want and len(want) > 500


def test_ten_thousand_globs(spark):
    """Every glob meets the paths of its folder only, not all."""
    globs = spark.range(10_000).selectExpr("concat('f', id, '/**/*.py') AS glob")
    paths = spark.range(3_000).selectExpr("concat('f', id * 3, '/x/y', id, CASE WHEN id % 2 = 0 THEN '.py' ELSE '.md' END) AS path")
    pairs = X.glob_pairs(paths, globs)
    assert pairs.count() == 1500
    assert "Cartesian" not in pairs._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_globs_of_names_meet_their_paths_only(spark):
    """Starts and ends of names below any folder: what is looked at grows with the matches, not with paths times globs."""
    paths = spark.range(2_000).selectExpr("concat('en/', lpad(id, 5, '0'), '/n', lpad(id * 7, 6, '0')) AS path")
    globs = spark.range(2_000).selectExpr("explode(array(concat('**/*', lpad(id * 7, 5, '0')), concat('**/n', lpad(id * 7, 6, '0'), '*'))) AS glob")
    pairs, looked_at = X.glob_pairs(paths, globs).count(), X.glob_candidates(paths, globs).count()
    assert pairs == 4_000 and looked_at == pairs


def test_literals_hold_in_every_match():
    """Odd globs: whatever a glob matches has its folders, the start of its name and its end."""
    r = random.Random(3)
    paths = ["".join(r.choice(["a", "b", "ab", "/", "//", ".py", "é", "a.md", "\n"]) for _ in range(r.randint(0, 6))) for _ in range(400)] + ["a" * 40 + "/" + "b" * 40]
    hits = 0
    for _ in range(1_500):
        g = "".join(r.choice(["/", "**/", "**", "*", "?", "a", "b", "ab", ".py", "a/", "é", "\\", "a.md"]) for _ in range(r.randint(0, 5)))
        _, depth, head, start, end = X.glob_literals(g)
        for p in filter(re.compile(X.glob_regex(g)).fullmatch, paths):
            parts, hits = p.split("/"), hits + 1
            assert p == head if depth < 0 else depth < len(parts) and "/".join(parts[:depth]) == head, (g, p)
            assert parts[-1].startswith(start) and p.endswith(end), (g, p)
    assert hits > 1_000
    assert X.glob_literals("a**/b*")[3] == "" and X.glob_literals("a/**/b*.py")[1:] == (1, "a", "b", ".py")
