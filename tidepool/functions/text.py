"""Column builders for note text: tokens, kinds, passages, globs, cards. JVM expressions, but where Python is named."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The stop words, the synonyms, the labels of a passage's header and the known context tags.
STOP_WORDS = "the a an is are to of and or for in on with how what should do i we it this that".split()
SYNONYMS = {
    "数据库": ["database", "sqlite", "sql"],
    "并发": ["concurrency", "concurrent"],
    "锁": ["lock", "locking"],
    "缓存": ["cache"],
    "认证": ["authentication", "auth"],
    "重试": ["retry"],
    "超时": ["timeout"],
    "循环": ["loop", "looped"],
    "插件": ["plugin", "plugins"],
}
LABELS = ["Title", "Filename", "Aliases", "Description", "Tags", "Project", "Module", "Sources"]
CONTEXT_TAGS = ["recommended_plugins", "environment_context", "in-app-browser-context", "skill", "skills_instructions", "INSTRUCTIONS"]
LESSON_FOLDERS = ["lessons", "经验"]
FIELD_LIMIT, CHUNK_FORMAT = 1600, 1

WORD = r"[a-z0-9_]+(?:[.$/-][a-z0-9_]+)*"
CJK = r"[\x{3400}-\x{9fff}\x{20000}-\x{2fa1f}]+"
CJK_RUN = re.compile(r"[\u3400-\u9fff\U00020000-\U0002fa1f]+")
#: What a byte of UTF-8 is to a token: in a word, between two parts of one, or the first of a character that may be CJK.
_IN_WORD, _JOINT, _IN_RUN = 1, 2, 3
_KINDS = np.zeros(256, np.uint8)
_KINDS[list(b"abcdefghijklmnopqrstuvwxyz0123456789_")] = _IN_WORD
_KINDS[list(b".$/-")] = _JOINT
_KINDS[[*range(0xE3, 0xEA), 0xF0]] = _IN_RUN


@F.pandas_udf(T.StringType())
def nfkc(x: pd.Series) -> pd.Series:
    """Compatibility composition; Spark has no built-in for it."""
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def _useful(x: Column) -> Column:
    return (x != "") & ~x.isin(STOP_WORDS)


def tokens(text: Column, expand: bool = False) -> Column:
    """Array of tokens of normalised text: words, their parts, CJK bigrams and, for queries, synonyms."""
    low = F.lower(text)
    words = F.filter(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), _useful)
    # most texts have no compound word: one look at the text is cheaper than one at each word
    compound = F.filter(words, lambda w: w.rlike("[.$/-]"))
    parts = F.when(low.rlike("[a-z0-9_][.$/-][a-z0-9_]"), F.flatten(F.transform(compound, lambda w: F.filter(F.split(w, "[.$/-]"), _useful)))).otherwise(F.array().cast("array<string>"))
    runs = F.regexp_extract_all(low, F.lit(CJK), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2))))))
    out = F.concat(words, parts, pairs)
    if expand:
        added = [F.when(F.contains(low, F.lit(k)), F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>")) for k, v in SYNONYMS.items()]
        out = F.concat(out, *added)
    return out


def token_rows(text: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """An Arrow kernel that finds what ``tokens`` finds in some texts: each token and the place of its text, without their order in it.

    Only two letters beyond ASCII have lower ones that are in tokens.
    """
    low = pc.ascii_lower(pc.replace_substring(pc.replace_substring(pc.fill_null(text, ""), "\u0130", "i\u0307"), "\u212a", "k"))
    low = pc.binary_join_element_wise(low, pa.scalar("", low.type), pa.scalar("\n", low.type))  # no word runs on into the next text
    ends = np.frombuffer(low.buffers()[1], np.int32)[low.offset : low.offset + len(low) + 1]
    data = np.frombuffer(low.buffers()[2] or b"", np.uint8)[: ends[-1]]
    kinds = _KINDS.take(data)
    inside = kinds == _IN_WORD
    joints = np.flatnonzero(kinds == _JOINT)
    joints = joints[(joints > 0) & inside[joints - 1]]
    joints = joints[inside[joints + 1]]  # the last byte is a line's end
    inside[joints] = True
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1  # every word ends before its text does
    edges = np.append(0, edges) if len(edges) % 2 else edges
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    words = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.py_buffer(np.compress(inside, data)))
    row = np.repeat(np.arange(len(low)), np.diff(np.searchsorted(starts, ends)))
    compound = np.unique(np.searchsorted(starts, joints, side="right") - 1)
    parts = pc.split_pattern_regex(words.take(pa.array(compound)), "[.$/-]")
    pairs, at = [], []
    for i in np.unique(np.searchsorted(ends, np.flatnonzero(kinds == _IN_RUN), side="right") - 1).tolist():  # texts that may have such runs
        for run in CJK_RUN.findall(low[i].as_py()):
            cut = [run[j : j + 2] for j in range(max(1, len(run) - 1))]
            pairs += cut
            at += [i] * len(cut)
    row = np.concatenate([row, np.repeat(row[compound], pc.list_value_length(parts).to_numpy()), np.array(at, np.int64)])
    found = pa.concat_arrays([words, parts.flatten(), pa.array(pairs, pa.string())]).dictionary_encode()
    useful = pc.invert(pc.is_in(found.dictionary, pa.array(STOP_WORDS))).to_numpy(zero_copy_only=False)[found.indices.to_numpy()]
    return pa.DictionaryArray.from_arrays(found.indices.to_numpy()[useful], found.dictionary), row[useful]


def query_terms(query: str) -> list[str]:
    """The distinct terms of one query, in order of code points; a query is one short string on the driver."""
    low = unicodedata.normalize("NFKC", query).lower()
    words = [w for w in re.findall(WORD, low) if w not in STOP_WORDS]
    found = set(words) | {p for w in words for p in re.split("[.$/-]", w) if p and p not in STOP_WORDS}
    for run in CJK_RUN.findall(low):
        found |= {run} if len(run) == 1 else {a + b for a, b in zip(run, run[1:], strict=False)}
    for word, others in SYNONYMS.items():
        if word in low:
            found |= set(others)
    return sorted(found)


def kind(type_: Column, path: Column) -> Column:
    """The explicit type, else ``lesson`` for notes under a lessons folder."""
    first = F.lower(F.split(path, "/")[0])
    return F.when(F.coalesce(type_, F.lit("")) != "", type_).when(first.isin(LESSON_FOLDERS), F.lit("lesson")).otherwise(F.lit(""))


def header(**fields: Column) -> Column:
    """Labelled lines in fixed order; a field is cut to FIELD_LIMIT characters, empty ones are left out."""
    lines = [F.when(F.coalesce(fields[k.lower()], F.lit("")) != "", F.concat(F.lit(f"{k}: "), F.substring(fields[k.lower()], 1, FIELD_LIMIT))) for k in LABELS if k.lower() in fields]
    return F.concat_ws("\n", *lines)


def passage(head: Column, heading: Column, text: Column) -> Column:
    return F.concat(head, F.lit("\nSection: "), heading, F.lit("\n\n"), text)


def fingerprint(text: Column) -> Column:
    """What tells whether a note has changed: the digest of its bytes."""
    return F.sha2(text, 256)


def passage_key(whole: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{CHUNK_FORMAT}\n"), whole), 256)


def title(meta_title: Column, body: Column, stem: Column) -> Column:
    """The given title, else the body's first level-one heading, else the file's stem."""
    first = F.trim(F.regexp_extract(body, r"(?md)^#(?U:\s)+(.+)$", 1))
    return F.coalesce(F.nullif(meta_title, F.lit("")), F.nullif(first, F.lit("")), stem)


def glob_regex(pattern: str) -> str:
    """A Java and Python regular expression for a path glob: ``**/`` any folders, ``**`` anything, ``*`` and ``?`` within a name."""
    steps = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    pieces = re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", pattern.replace("\\", "/"))
    return "".join(steps.get(p) or re.escape(p) for p in pieces)


def glob_matches(pattern: str, path: Column) -> Column:
    clean = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", "")
    return clean.rlike(f"(?d)^(?:{glob_regex(pattern)})$(?!\n)")


@F.pandas_udf(T.BooleanType())
def any_glob(patterns: pd.Series, path: pd.Series) -> pd.Series:
    """Whether any of a row's own patterns matches; for patterns that differ by row. Patterns are compiled once each."""
    known: dict[str, re.Pattern] = {}

    def hit(globs: list[str], p: str) -> bool:
        p = p.replace("\\", "/").removeprefix("./")
        for g in globs:
            if g not in known:
                known[g] = re.compile(glob_regex(g))
            if known[g].fullmatch(p):
                return True
        return False

    return pd.Series([hit(g if g is not None else [], p) for g, p in zip(patterns, path, strict=True)])


#: Lengths that the start of a glob's name and its end are compared by: the largest that the glob has; few, so that its shapes are few.
CUTS = [*range(13), 16, 24, 32]


def glob_literals(pattern: str) -> tuple[str, int, str, str, str]:
    """regex, depth, head, start, end: what a glob's matches have without fail.

    ``head`` are their first ``depth`` folders, ``start`` begins their name and ``end`` ends them, each cut to one of CUTS. A glob
    without wildcards is its own head, at depth -1.
    """
    given = pattern.replace("\\", "/")
    regex = f"(?d)^(?:{glob_regex(given)})$(?!\n)"
    pieces = re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", given)
    literal = [p[0] not in "*?" for p in pieces]
    if all(literal):
        return regex, -1, given, "", ""
    folders, slash, _ = pieces[0].rpartition("/") if literal[0] else ("", "", "")
    # the name is what follows the last slash; a ``**/`` may match nothing, so it begins a name only where what stands before it ends a folder
    at = max((i for i, p in enumerate(pieces) if p == "**/" or literal[i] and "/" in p), default=-1)
    name, bounded = pieces[at + 1 :], True
    if at >= 0 and literal[at]:
        name = [pieces[at].rpartition("/")[2], *name]
    elif at >= 0:
        before = next((i for i in range(at, -1, -1) if pieces[i] != "**/"), -1)
        bounded = before < 0 or literal[before] and pieces[before].endswith("/")
    whole = bounded and "**" not in name
    start = name[0] if whole and name and name[0][:1] not in ("", "*", "?") else ""
    end = pieces[-1] if literal[-1] else ""
    cut = lambda x: max(n for n in CUTS if n <= len(x))
    return regex, folders.count("/") + 1 if slash else 0, folders, start[: cut(start)], end[len(end) - cut(end) :]


@F.pandas_udf(T.StructType([T.StructField(k, T.IntegerType() if k == "depth" else T.StringType()) for k in ("regex", "depth", "head", "start", "ending")]))
def glob_asks(x: pd.Series) -> pd.DataFrame:
    """glob_literals() of a column, the regex anchored for rlike."""
    return pd.DataFrame([(None,) * 5 if g is None else glob_literals(g) for g in x], columns=["regex", "depth", "head", "start", "ending"])


def glob_candidates(paths: DataFrame, globs: DataFrame) -> DataFrame:
    """path, clean, glob, regex of the pairs that glob_pairs() looks at.

    A glob meets those paths only that have all of its literals: its first folders, the start of its name, its end. The shapes
    of globs (how many folders, how long a start and an end) are few; a path has a row for each shape that it's long enough
    for, and an equi-join finds the globs of that shape with the same literals. So rows grow with the paths and the matches,
    but for globs whose only literals are in their midst (``**/*x*``).
    """
    clean = F.regexp_replace(F.replace(F.col("path"), F.lit("\\"), F.lit("/")), r"^\./", "")
    asked = globs.filter("glob is not null").select("glob", glob_asks("glob").alias("ask")).select("glob", "ask.*")
    sizes = [F.length("start").alias("starts"), F.length("ending").alias("ends")]
    shapes = asked.select("depth", *sizes).distinct()
    parts = F.split("clean", "/")
    rows = paths.select("path", clean.alias("clean")).select("path", "clean", F.explode(F.sequence(F.lit(-1), F.size(parts) - 1)).alias("depth"))
    rows = rows.join(F.broadcast(shapes), "depth")
    name = F.element_at(parts, -1)
    rows = rows.filter((F.length(name) >= F.col("starts")) & (F.length("clean") >= F.col("ends")))
    head = F.when(F.col("depth") < 0, F.col("clean")).otherwise(F.array_join(F.slice(parts, F.lit(1), F.greatest("depth", F.lit(0))), "/"))
    rows = rows.select("path", "clean", "depth", head.alias("head"), F.left(name, F.col("starts")).alias("start"), F.right("clean", F.col("ends")).alias("ending"))
    return rows.join(asked, ["depth", "head", "start", "ending"]).select("path", "clean", "glob", "regex")


def glob_pairs(paths: DataFrame, globs: DataFrame) -> DataFrame:
    """path, glob of every match between two tables of distinct values: of the candidates, those that the glob's expression finds."""
    return glob_candidates(paths, globs).filter(F.rlike("clean", F.col("regex"))).select("path", "glob").distinct()


_HEAD = r"\s*# AGENTS\.md instructions(?: for [^\n]+)?[ \t\r\x0B\f]*(?:\n|\z)"
#: Alternatives spelt out, one per tag, so that the same expression works without back-references.
CONTEXT = "(?:" + "|".join([_HEAD, *(rf"\s*<{t}(?:\s+[^<>]*)?>(?s:.*?)</{t}>\s*" for t in CONTEXT_TAGS)]) + ")+"


def context_prefix(text: Column) -> Column:
    """The leading run of known context blocks; '' without one."""
    return F.regexp_extract(text, rf"^({CONTEXT})", 1)


def quoted(text: Column) -> Column:
    return F.concat(F.lit("> "), F.replace(text, F.lit("\n"), F.lit("\n> ")))


def card(kind_: Column, label: Column, content: Column, folded: bool = False) -> Column:
    """A callout; a folded one fences its content by more backticks than any run in it."""
    if folded:
        runs = F.transform(F.regexp_extract_all(content, F.lit("`+"), F.lit(0)), lambda r: F.length(r) + 1)
        fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(3))))
        content = F.concat(fence, F.lit("text\n"), content, F.lit("\n"), fence)
    return F.concat(F.lit("> [!"), kind_, F.lit("]-" if folded else "]"), F.lit(" "), label, F.lit("\n>\n"), quoted(content), F.lit("\n\n"))


def two_digits(n: Column) -> Column:
    return F.format_string("%02d", n)


def message_card(role: Column, number: Column, clock: Column, content: Column, client: str, collapse_context: bool = True) -> Column:
    """A message as cards: the folded context before a user's request, the message, and its block id."""
    suffix = F.concat(F.lit(" · "), two_digits(number), F.when(clock != "", F.concat(F.lit(" · "), clock)).otherwise(F.lit("")))
    context = F.when(F.lit(collapse_context) & (role == "user"), context_prefix(content)).otherwise(F.lit(""))
    body = F.substring(content, F.length(context) + 1, F.length(content))
    own = F.when(role == "user", F.lit("你")).otherwise(F.lit("Codex" if client == "codex" else "Claude"))
    first = F.when(context != "", card(F.lit("info"), F.concat(F.lit("环境 / Skill 原文"), suffix), context, folded=True)).otherwise(F.lit(""))
    second = F.when((body != "") | (context == ""), card(F.when(role == "user", F.lit("question")).otherwise(F.lit("success")), F.concat(own, suffix), body)).otherwise(F.lit(""))
    return F.concat(first, second, F.lit("^message-"), two_digits(number), F.lit("\n\n"))


# What file names and links can't hold, what stands for it, what is cut from the ends, the most UTF-8 bytes, and
# the name of a title without any usable character.
FORBIDDEN, STAND_IN, ENDS, MOST_BYTES, NAMELESS = '<>:"/\\|?*[]#^', "-", " .-", 140, "conversation"


def filename_title(value: str) -> str:
    """A readable file name: composed, printable, of at most MOST_BYTES bytes, never empty."""
    name, size = "", 0
    shown = (STAND_IN if c in FORBIDDEN else c for c in unicodedata.normalize("NFC", value) if unicodedata.category(c)[0] != "C")
    for c in " ".join("".join(shown).split()).strip(ENDS):
        size += len(c.encode())
        if size > MOST_BYTES:
            break
        name += c
    return name.rstrip(ENDS) or NAMELESS


@F.pandas_udf(T.StringType())
def filename_titles(x: pd.Series) -> pd.Series:
    return x.map(lambda s: filename_title(s or ""))


def session_slug(session_id: Column) -> Column:
    dashed = F.regexp_replace(session_id, r"(?U)[^\w-]", "-")
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, 60), F.lit("")), F.lit("session"))


def unescaped(text: Column) -> Column:
    """Percent escapes of a link read as UTF-8; what isn't a well-formed escape stays, bytes that aren't UTF-8 become U+FFFD."""
    lone = F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25")
    pieces = F.split(F.regexp_replace(lone, "((?:%[0-9A-Fa-f]{2})+)", "\u0000$1\u0000"), "\u0000")
    read = lambda p: F.when(p.startswith("%"), F.make_valid_utf8(F.unhex(F.replace(p, F.lit("%"), F.lit(""))).cast("string"))).otherwise(p)
    return F.when(F.contains(lone, F.lit("%")), F.array_join(F.transform(pieces, read), "")).otherwise(text)


def link_target(link: Column) -> Column:
    """The target of a wiki or Markdown link or of a bare path; null where it can't name a note."""
    text = F.trim(link)
    wiki = text.startswith("[[") & text.endswith("]]")
    inner = F.regexp_extract(text, r"^\[\[([^|#]*).*\]\]$", 1)
    named = F.regexp_extract(text, r"^\[[^\]]*\]\((.+)\)$", 1)
    plain = F.split(unescaped(F.when(named != "", named).otherwise(text)), "#")[0]
    target = F.when(wiki, inner).otherwise(plain)
    return F.when((target != "") & ~F.contains(target, F.lit("://")) & ~target.startswith("/"), target)
