"""Secret scans with a random forest that removes false positives, with DataFrame and SQL functions only.

Candidates are whole blocks of private keys; values of any length and any symbols that an assignment gives to a credential; runs behind
known prefixes; passwords in addresses; tokens of eight and more characters with small and capital letters, digits and symbols; and runs of 16 and more key
characters, letters alone included, unless all are one letter. Each is described by its length, its character classes and the turns
between them, how likely its letters follow each other in the corpus' words, how much of it dictionary words cover, and the words and
path around it. The dictionary is the `most_words` commonest words of all documents, the transitions are those of its letters. A
random forest is trained from labelled findings; the trained trees become one SQL expression that walks arrays of nodes, so that
scanning is a projection: it reads a text once, shuffles nothing and runs wherever a column expression does.

Labelled findings are any rows (before, secret, after, label). `labelled_findings` makes a bounded set around words of the documents:
keys and passwords of usual make, in and out of assignments, against slugs, dates, numbers, paths, words and placeholders in the same
places, and against hashes, ids, digests and pictures where no credential is named. Hexadecimal runs and UUIDs count as keys only where one is. Some are made from fixed words, so there is a forest whatever the documents' lengths and number.

Null and empty texts have no findings and stay as they are (null as null). Nothing is cut off: all candidates of a whole text
are judged. Rows that repeat are answered row by row; no rows give none. `with_findings` and `redacted` keep all columns of the input, whatever
their names, and replace those named as their outputs. The name of a credential may have 255 characters between its word and the sign of assignment.
Not a candidate is a value under 16 characters that no assignment, prefix or
mix of all four kinds of characters marks; a plain word as a password is one, but looks to the forest like any word.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, written

_KEY = r"A-Za-z0-9+/_\-"
#: Words that mark an assignment of a credential, and words that placeholders, slugs and paths are made of.
CREDENTIAL = "token|secret|passw|passphrase|pwd|api[_ -]?key|[_-]key|auth|credential|private|access|bearer"
_PREFIX = "AKIA|ASIA|gh[pousr]_|github_pat_|xox[baprs]-|AIza|eyJ|sk[_-]|glpat-"
_QUOTE = "[\"'`]"
_VALUE = rf"(?:(?<={_QUOTE})[^\s\"'`<>]++(?={_QUOTE})|(?<!{_QUOTE})(?![=:>\"'`])[^\s\"'`<>,;]*[^\s\"'`<>,;.:?()\[\]{{}}])"
#: What stands before the value in a match: a sign of assignment, the word bearer, or the user of an address.
_HEAD = rf"^(?:://[^\s/:@\"'<>]*:|[=:>]{{1,2}}\s*(?:(?i:basic|bearer|token)\s+)?{_QUOTE}?|(?:[bB]earer|BEARER)\s+)"
#: Characters of a name between the word of a credential and its sign: Java looks back over a stated length only.
_NAME = 255
# each kind starts with a character or a border that prose seldom has, so that most places of a text are passed at once
_KINDS = (
    # a block of a private key, to its end if it has one
    "-----BEGIN [A-Z0-9 ]*?PRIVATE KEY(?: BLOCK)?-----(?:[^\\-]*+-----END [A-Z0-9 ]*+-----)?",
    # the password in an address
    r"://[^\s/:@\"'<>]*+:[^\s/@\"'<>]++(?=@)",
    # values given to a credential, in quotes and without
    rf"[=:>]{{1,2}}(?<=(?i:{CREDENTIAL})[\w.\-]{{0,{_NAME}}}[\"'`\])]{{0,2}}\s{{0,20}}[=:>]{{1,2}})\s*+(?:(?i:basic|bearer|token)\s++)?{_QUOTE}?{_VALUE}",
    rf"(?:[bB]earer|BEARER)(?<!\w.{{6}})\s++{_VALUE}",
    rf"(?<![{_KEY}])(?:(?=e)eyJ[{_KEY}]{{4,}}+(?:\.[{_KEY}]{{2,}}+)*+|(?=[{_KEY}]{{16}})(?=[+/_\-]*+[A-Za-z0-9])(?!([A-Za-z])\1*+(?![{_KEY}]))[{_KEY}]{{16,}}+|(?=[Agxs])(?:{_PREFIX})[{_KEY}]{{4,}}+)={{0,2}}",
)
#: Tokens of all four kinds of characters; only texts with digits and symbols can have one.
_MIXED = r"(?<!\S)(?=[^\s!@#$%^*~+]*+[!@#$%^*~+])(?=\S*[0-9])(?=\S*[A-Z])(?=\S*[a-z])[^\s\"'`<>/:=?&,;()\[\]{}]{8,}+(?=[\s.,;:)]|\z)"
# each kind starts with a character or a border that prose seldom has, so that most places of a text are passed at once
CANDIDATE = "|".join((*_KINDS[:4], _MIXED, *_KINDS[4:]))
_PLAIN = "|".join(_KINDS)
COMMON = "example|sample|test|dummy|your|here|placeholder|changeme|token|secret|key|http|https|www|com|html|index|page|image|file|path|user|name|version|release|build|node|data|the|and|with|from"
#: Makes that hashes, numbers of builds and ids have as well as keys have; words that name them; the user of an address; a credential's sign.
_HASH = r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}|sha[0-9]{1,3}-[A-Za-z0-9+/]+={0,2})$"
_HASHED = r"(?i)(?:commit|sha-?[0-9]*|md5|digest|checksum|revision|hash|etag|integrity|[ug]uid|base64|fingerprint|tree|parent|blob)[\"']?[^A-Za-z0-9]{0,4}$"
_USER = r"://[^\s/:@]*:$"
_GIVEN = rf"(?:(?i:{CREDENTIAL})[\w.\-]*[\"'`\])]{{0,2}}\s*[=:>]{{1,2}}\s*(?:(?i:basic|bearer|token)\s+)?|(?i:bearer)\s+)[\"'`]?$"
#: Slots of the dictionary.
_SLOTS = 4096
_WORDS = "river stone garden window morning letter paper music table green forest water light house summer winter people government between information"


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _share(c: str, pattern: str) -> str:
    """Share of the characters of `c` that a pattern covers."""
    return f"(length({c}) - length(regexp_replace({c}, {_sql(pattern)}, ''))) / CAST(length({c}) AS DOUBLE)"


def _array(values: Iterable, kind: str) -> str:
    """A constant array as SQL: one string, which is split once per query."""
    return f"CAST(split('{','.join(map(str, values))}', ',') AS array<{kind}>)"


@dataclass(frozen=True)
class Lexicon:
    """The corpus' commonest words and, for each pair of letters, the log probability that the second follows the first."""

    words: tuple[str, ...]
    follows: tuple[float, ...]


def lexicon(docs: DataFrame, most_words: int = 5000) -> Lexicon:
    """Counted over all words of three and more letters of all documents; `most_words` of them are kept, ties by name."""
    words = docs.select(F.explode(F.expr("regexp_extract_all(lower(CAST(text AS STRING)), '(?<![a-z0-9])[a-z]{3,}+(?![a-z0-9])', 0)")).alias("w")).groupBy("w").count()
    found = words.orderBy(F.desc("count"), "w").limit(most_words).collect()
    pairs = [1.0] * 676
    for w, n in found:
        for x, y in zip(w, w[1:], strict=False):
            pairs[(ord(x) - 97) * 26 + ord(y) - 97] += n
    total = [sum(pairs[i : i + 26]) for i in range(0, 676, 26)]
    return Lexicon(tuple(w for w, _ in found), tuple(round(math.log(v / total[i // 26]), 4) for i, v in enumerate(pairs)))


def features(c: str, b: str, a: str, lex: Lexicon) -> dict[str, str]:
    """Features of a finding as SQL over its text, the text before and the text after it."""
    quote = "[\"" + chr(39) + "]"
    # the words stand in slots by checksum, so each is looked up in a short text
    slots = [""] * _SLOTS
    for w in lex.words:
        slots[zlib.crc32(w.encode()) % _SLOTS] += f" {w} "
    known = f"contains(get(split('{','.join(slots)}', ','), CAST(crc32(CAST(lower(w) AS BINARY)) % {_SLOTS} AS INT)), concat(' ', lower(w), ' '))"
    follows = _array(lex.follows, "double")
    step = f"CASE WHEN s[i - 1] BETWEEN 0 AND 25 AND s[i] BETWEEN 0 AND 25 THEN named_struct('t', m.t + get({follows}, s[i - 1] * 26 + s[i]), 'n', m.n + 1) ELSE m END"
    mean = f"aggregate(sequence(1, greatest(1, size(s) - 1)), named_struct('t', 0D, 'n', 0), (m, i) -> CASE WHEN i < size(s) THEN {step} ELSE m END, m -> CASE WHEN m.n = 0 THEN {-math.log(26)}D ELSE m.t / m.n END)"
    return {
        "length": f"length({c})",
        "digits": _share(c, "[0-9]"),
        "uppers": _share(c, "[A-Z]"),
        "hexes": _share(c, "[0-9a-fA-F]"),
        "marks": _share(c, "[^A-Za-z0-9]"),
        "turns": f"CAST(size(regexp_extract_all({c}, '[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]', 0)) AS DOUBLE) / length({c})",
        "transitions": f"transform(array(transform(split(lower({c}), ''), k -> ascii(k) - 97)), s -> {mean})[0]",
        "variety": f"size(array_distinct(split({c}, ''))) / sqrt(length({c}))",
        "dictionary": f"aggregate(transform(regexp_extract_all({c}, '[A-Z]?[a-z]+|[A-Z]+', 0), w -> CASE WHEN {known} THEN length(w) ELSE 0 END), 0, (m, n) -> m + n) / CAST(length({c}) AS DOUBLE)",
        "placeholder": _share(c, f"(?i){COMMON}"),
        "longest_word": f"coalesce(array_max(transform(regexp_extract_all({c}, '[A-Za-z]+', 0), w -> length(w))), 0)",
        "known_prefix": f"CAST({c} rlike '^({_PREFIX}|-----BEGIN)' AS INT)",
        "credential_before": f"CAST({b} rlike {_sql(f'(?i)({CREDENTIAL})')} AS INT)",
        "assigned": f"CAST({b} rlike {_sql('[=:]' + chr(92) + 's*' + quote + '?$')} AS INT)",
        "symbols": _share(c, "[^A-Za-z0-9/+=._-]"),
        "reference": f"CAST({c} rlike {_sql('[(){}<>]|' + chr(92) + '[|^[$%]')} AS INT)",
        "capitals_first": f"CAST({c} rlike '^[A-Z][a-z]*$' AS INT)",
        "quoted_after": f"CAST({a} rlike {_sql('^' + quote)} AS INT)",
        "plain_hash": f"CAST({c} rlike {_sql(_HASH)} AS INT)",
        "named_hash": f"CAST({b} rlike {_sql(_HASHED)} AS INT)",
        "in_address": f"CAST({b} rlike {_sql(_USER)} AS INT)",
        "assigned_credential": f"CAST({b} rlike {_sql(_GIVEN)} AS INT)",
        "path_before": f"CAST({b} rlike '[/.]$' AS INT)",
        "path_after": f"CAST({a} rlike '^([.][A-Za-z]|[/@])' AS INT)",
    }


def labelled_findings(docs: DataFrame, most: int = 150) -> DataFrame:
    """before, secret, after, label: a bounded set of findings made around words of about `most` documents, chosen by hash."""
    rows = docs.select(F.col("text").cast("string").alias("t"))
    # a share of 2^53, so that any number of rows leaves a sample
    rows = rows.filter(F.pmod(F.xxhash64("t"), F.lit(1 << 53)) < int((1 << 53) * min(1.0, most / max(docs.count(), 1)))).filter("length(t) > 0").dropDuplicates(["t"])
    own = F.expr(f"array_join(transform(sequence(0, 19), i -> get(split('{_WORDS}', ' '), CAST(pmod(xxhash64(id, i), {len(_WORDS.split())}) AS INT))), ' ')")
    rows = rows.unionByName(docs.sparkSession.range(0, 100, 1, 1).select(own.alias("t")))
    rows = rows.select(F.expr(f"regexp_extract_all(t, '[A-Za-z]+', 0) || split('{_WORDS}', ' ')").alias("w"), F.sha2("t", 512).alias("h"), F.xxhash64("t").alias("r"))
    # seven words from anywhere in the text
    rows = rows.withColumn("w", F.expr("transform(sequence(0, 6), i -> w[pmod(xxhash64(r, i), size(w))])"))
    rows = rows.withColumns({"mixed": F.expr("translate(base64(unhex(h)), '+/=', 'xyz')"), "letters": F.expr("translate(base64(unhex(h)), '+/=0123456789', 'xyzgkwqbvjtrm')")})
    mixed, letters = "mixed", "letters"
    word = lambda i: f"w[{i}]"
    uuid = "concat_ws('-', substring(h, 1, 8), substring(h, 9, 4), substring(h, 13, 4), substring(h, 17, 4), substring(h, 21, 12))"
    made = {
        1: [
            "concat('AKIA', upper(substring(translate(base64(unhex(h)), '+/=', 'xyz'), 1, 16)))",
            "concat('ghp_', substring(translate(base64(unhex(h)), '+/=', 'xyz'), 1, 36))",
            "concat('sk_live_', substring(translate(base64(unhex(h)), '+/=', 'xyz'), 5, 24))",
            "concat('glpat-', substring(translate(base64(unhex(h)), '+/=', 'xyz'), 9, 20))", "concat('xoxb-', pmod(r, 1000000000000), '-', substring(translate(base64(unhex(h)), '+/=', 'xyz'), 9, 24))",
            "concat('AIza', substring(translate(base64(unhex(h)), '+/=', 'xyz'), 3, 35))", "concat('gho_', substring(translate(base64(unhex(h)), '+/=', 'xyz'), 8, 36))", "concat('eyJ', substring(translate(base64(unhex(h)), '+/=', 'xyz'), 2, 60))",
            "concat('-----BEGIN RSA PRIVATE KEY-----', chr(10), base64(unhex(repeat(h, CAST(1 + pmod(r, 9) AS INT)))), chr(10), '-----END RSA PRIVATE KEY-----')", "concat('-----BEGIN PRIVATE KEY-----', chr(10), substring(base64(unhex(h)), 1, 30), '==', chr(10), '-----END PRIVATE KEY-----')", "'-----BEGIN EC PRIVATE KEY-----'",
            "substring(base64(unhex(h)), 1, 40)", "concat(substring(base64(unhex(h)), 7, 42), '==')",
            f"concat('AKIA', upper(substring({letters}, 1, 16)))", f"substring({letters}, 3, 40)", f"lower(substring({letters}, 9, 32))", f"upper(substring({letters}, 5, 24))",
            f"concat(substring({mixed}, 1, 6), '$', substring({mixed}, 8, 5), '!', substring({mixed}, 14, 4))", f"concat(substring({mixed}, 21, 4), '@', pmod(r, 100), substring({mixed}, 27, 3), '#')",
        ],
        0: [
            # hashes, ids and pictures
            "substring(h, 1, 40)", "substring(h, 9, 32)", "upper(substring(h, 3, 40))", "substring(h, 1, 64)", "h", "substring(h, 1, 40)", "substring(h, 1, 64)",
            uuid, f"upper({uuid})", "concat('iVBORw0KGgoAAAANSUhEUg', base64(unhex(repeat(h, 6))))", "base64(unhex(repeat(h, 3)))", "concat('sha512-', base64(unhex(h)))",
            f"concat_ws('-', {word(0)}, {word(1)}, {word(2)}, {word(3)}, '2024')", f"concat_ws('_', {word(1)}, {word(2)}, {word(3)}, pmod(r, 100))",
            f"concat({word(0)}, {word(1)}, {word(2)}, pmod(r, 10), {word(3)})", "lpad(CAST(abs(r % 1000000000000000) AS STRING), 16, '4')",
            "concat('2024-01-', 10 + pmod(r, 20), '-00-00-00')", f"concat('/', {word(0)}, '/', {word(1)}, '/', {word(2)}, '/', pmod(r, 1000))",
            "concat('your-token-here-', pmod(r, 1000))", "concat('example', repeat('x', 12), pmod(r, 10))", "concat(repeat('0', 14), pmod(r, 1000))",
            f"concat('image_', {word(0)}, '_file_', pmod(r, 10000))",
            f"repeat(lower(substring({word(0)}, 1, 1)), CAST(16 + pmod(r, 100) AS INT))", f"repeat(upper(substring({word(1)}, 1, 1)), 300)",
            f"concat_ws('-', {word(0)}, {word(1)}, {word(2)}, {word(3)})", f"concat_ws('/', {word(1)}, {word(2)}, {word(3)}, {word(0)})", f"concat({word(0)}, {word(2)}, {word(1)}, {word(3)})",
            f"concat(initcap({word(0)}), initcap({word(1)}), initcap({word(2)}))", f"concat({word(0)}, '.', initcap({word(1)}), pmod(r, 100), '@', {word(2)}, '.com')",
        ],
    }
    # what stands in assignments only
    given = {
        1: ["substring(h, 1, 40)", "substring(h, 9, 32)", "upper(substring(h, 3, 40))", "substring(h, 1, 64)", uuid, "substring(h, 5, 20)", f"concat(lower({word(0)}), pmod(r, 10))", f"concat(lower({word(2)}), pmod(r, 10000))", f"concat({word(3)}, '_', pmod(r, 1000))", f"concat(lower({word(1)}), 1 + pmod(r, 9))", f"concat(lower({word(4)}), pmod(r, 100))", f"concat(initcap({word(5)}), pmod(r, 100))",
            f"substring({mixed}, 3, 8)", f"substring({mixed}, 11, 12)", f"concat(substring({mixed}, 2, 5), '!', pmod(r, 100))", f"concat(initcap({word(0)}), pmod(r, 1000), '!')", f"lower(substring({letters}, 2, 12))", f"substring({letters}, 20, 10)",
            f"concat(translate({word(1)}, 'aeios', '@3105'), pmod(r, 1000), '#')", f"concat(lower(substring({mixed}, 4, 3)), '^', substring({mixed}, 30, 3), '&', pmod(r, 10))"],
        0: ["repeat(substring(h, 1, 1), 6)", word(0), word(1), f"lower({word(2)})", f"initcap({word(3)})", "pmod(r, 1000)", "pmod(r, 10)", "get(array('null', 'none', 'true', 'false', 'changeme', 'password', 'required', 'xxxxxx', '******', 'string'), CAST(pmod(r, 10) AS INT))",
            f"concat('${{', upper({word(0)}), '_', upper({word(1)}), '}}')", f"concat('get_', lower({word(2)}), '()')", f"concat('config.', lower({word(1)}))", "'os.environ[TOKEN]'", f"concat('your_', lower({word(3)}))"],
    }
    named = "get(array('commit ', 'image@sha256:', 'sha256:', 'md5 = ', 'checksum: ', 'revision ', 'etag: \"', 'uuid: ', 'integrity=\"', 'data:image/png;base64,', 'tree ', 'id: '), CAST(pmod(xxhash64(secret), 12) AS INT))"
    befores = [
        "concat('token = ', chr(34))", "'api_key: '", "'password='", "concat('secret: ', chr(39))", f"concat({word(4)}, ' ')", f"concat({word(5)}, ' ', {word(4)}, ' ')",
        f"concat({word(4)}, ' ', {named})", f"concat('postgres://', lower({word(5)}), ':')", f"concat('auth_key_of_', lower({word(4)}), '_', lower({word(5)}), ' = ')",
    ]
    out = []
    for label, kinds in made.items():
        for at, kind in enumerate(kinds):
            # keys stand in assignments more often than not, other things now and then
            places = [at % 4, (at + 1) % 4, 4, 5, 6] if label and at < 11 else [at % 4, (at + 1) % 4, 4 + at % 2] if label else [4, 5, 6] if at < 12 else [4, 5, at % 4]
            out.append((kind, places, label))
    out += [(kind, [0, 1, 2, 3, 8] + [7] * label, label) for label, kinds in given.items() for kind in kinds]
    kinds = ", ".join(f"struct(CAST({kind} AS STRING) AS secret, array({', '.join(map(str, places))}) AS places, {label} AS label)" for kind, places, label in out)
    rows = rows.select("w", F.expr(f"inline(array({kinds}))")).filter("secret <> ''")
    rows = rows.select("w", "secret", "label", F.explode("places").alias("at"))
    after = f"concat(CASE at WHEN 0 THEN chr(34) WHEN 3 THEN chr(39) ELSE ' ' END, ' ', {word(6)})"
    return rows.selectExpr(f"get(array({', '.join(befores)}), at) AS before", "secret", f"{after} AS after", "label")


@dataclass(frozen=True)
class Forest:
    """Trees as nodes (feature, threshold, node below it, node above it, vote), feature -1 for leaves; roots; and the lexicon of the features."""

    nodes: tuple[tuple[int, float, int, int, int], ...]
    roots: tuple[int, ...]
    depth: int
    lexicon: Lexicon

    def votes(self, x: str) -> str:
        """SQL for the share of trees that vote for 'secret' over an array x of features."""
        if not self.roots:
            return "0.0D"
        feature, threshold, low, high, vote = (_array(c, kind) for c, kind in zip(zip(*self.nodes, strict=True), ("int", "double", "int", "int", "int"), strict=True))
        step = f"CASE WHEN get({feature}, n) < 0 THEN n WHEN get({x}, get({feature}, n)) <= get({threshold}, n) THEN get({low}, n) ELSE get({high}, n) END"
        leaf = f"aggregate(sequence(1, {self.depth}), r, (n, d) -> {step})"
        return f"(aggregate({_array(self.roots, 'int')}, 0, (m, r) -> m + get({vote}, {leaf})) / CAST({len(self.roots)} AS DOUBLE))"


def _read(model, lex: Lexicon, depth: int) -> Forest:
    """The trained trees, from the text in which Spark describes them."""
    nodes: list[tuple[int, float, int, int, int]] = []

    def read(lines: list[str]) -> int:
        line, at = lines.pop(0).strip(), len(nodes)
        nodes.append((-1, 0.0, at, at, 0))
        if line.startswith("Predict:"):
            nodes[at] = (-1, 0.0, at, at, int(float(line.split()[1]) > 0.5))
            return at
        m = re.match(r"If \(feature (\d+) <= ([-0-9.Ee]+)\)", line)
        low = read(lines)
        lines.pop(0)  # Else
        nodes[at] = (int(m[1]), float(m[2]), low, read(lines), 0)
        return at

    roots = tuple(read(t.toDebugString.strip().split("\n")[1:]) for t in model.trees)
    return Forest(tuple(nodes), roots, depth, lex)


def described(findings: DataFrame, lex: Lexicon) -> DataFrame:
    """Features and label of labelled findings."""
    rows = findings.select(F.col("secret").alias("c"), F.col("before").alias("b"), F.col("after").alias("a"), "label")
    return rows.select(*(F.expr(f"CAST({e} AS DOUBLE)").alias(k) for k, e in features("c", "b", "a", lex).items()), F.col("label").cast("double").alias("label"))


def fit(rows: DataFrame, trees: int = 24, depth: int = 6, seed: int = 7):
    """The random forest over a bounded table of `described` rows; None if they are of one kind. Rows are sorted in one partition, so the
    same findings give the same forest on any cluster."""
    if rows.groupBy("label").count().count() < 2:
        return None
    rows = rows.coalesce(1).sortWithinPartitions(*rows.columns)
    data = VectorAssembler(inputCols=[c for c in rows.columns if c != "label"], outputCol="x").transform(rows).select("x", "label")
    return RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(data)


def train(findings: DataFrame, lex: Lexicon, trees: int = 24, depth: int = 6, seed: int = 7) -> Forest:
    """The forest of labelled findings as an expression."""
    # a bounded table that the forest reads once per level
    model = fit(written(described(findings, lex), "findings"), trees, depth, seed)
    return Forest((), (), depth, lex) if model is None else _read(model, lex, depth)


def trained(docs: DataFrame, most: int = 150, most_words: int = 5000) -> Forest:
    """The forest for these documents: their dictionary, and findings made around their words."""
    return train(labelled_findings(docs, most), lexicon(docs, most_words))


def with_findings(docs: DataFrame, forest: Forest, text: str = "text", out: str = "findings", parts: str | None = None, around: int = 48) -> DataFrame:
    """`docs` with `out`: array<struct<ordinal, head, secret, before, after, score>> of all candidates in order, and, if named, `parts`:
    the texts between them. A head is the sign or word of assignment that belongs to a match. Neighbours are words within `around` characters."""
    t = f"coalesce(`{text}`, '')"
    docs = docs.drop(out, *([parts] if parts else []))
    c, p = fresh(docs, "_c"), parts or fresh(docs, "_p")
    mixed = f"{t} rlike '[0-9]' AND {t} rlike '[!@#$%^*~+]'"
    found = f"CASE WHEN {mixed} THEN regexp_extract_all({t}, {_sql(CANDIDATE)}, 0) ELSE regexp_extract_all({t}, {_sql(_PLAIN)}, 0) END"
    docs = docs.withColumn(c, F.expr(f"transform({found}, m -> struct(m AS m, regexp_replace(m, {_sql(_HEAD)}, '') AS c))"))
    docs = docs.withColumn(p, F.expr(f"CASE WHEN size(`{c}`) = 0 THEN array({t}) WHEN {mixed} THEN split({t}, {_sql(CANDIDATE)}, -1) ELSE split({t}, {_sql(_PLAIN)}, -1) END"))
    head = "left(x.m, length(x.m) - length(x.c))"
    near = f"transform(`{c}`, (x, i) -> struct(i AS i, {head} AS h, x.c AS c, right(concat(get(`{p}`, i), {head}), {int(around)}) AS b, left(get(`{p}`, i + 1), {int(around)}) AS a))"
    values = ", ".join(f"CAST({e} AS DOUBLE)" for e in features("x.c", "x.b", "x.a", forest.lexicon).values())
    seen = f"transform({near}, x -> struct(x.i AS i, x.h AS h, x.c AS c, x.b AS b, x.a AS a, array({values}) AS f))"
    judged = f"transform({seen}, y -> struct(y.i AS ordinal, y.h AS head, y.c AS secret, y.b AS before, y.a AS after, {forest.votes('y.f')} AS score))"
    return docs.withColumn(out, F.expr(judged)).drop(*([c] if parts else [c, p]))


def findings(docs: DataFrame, forest: Forest, threshold: float = 0.5) -> DataFrame:
    """doc_id, ordinal (of the candidate in its text), n_chars, secret_sha256, score, is_secret: a row per candidate."""
    rows = with_findings(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), forest)
    # a filter on the array, which explode() implies, would be pushed below the patterns and have them matched again and again
    rows = rows.select("doc_id", F.explode_outer("findings").alias("x")).filter("x is not null")
    return rows.select(
        "doc_id",
        F.col("x.ordinal").cast("long").alias("ordinal"),
        F.char_length("x.secret").cast("long").alias("n_chars"),
        F.sha2(F.col("x.secret").cast("binary"), 256).alias("secret_sha256"),
        F.col("x.score").alias("score"),
        (F.col("x.score") >= threshold).alias("is_secret"),
    )


def redacted(docs: DataFrame, forest: Forest, threshold: float = 0.5, mark: str = "<secret>") -> DataFrame:
    """`docs`, all columns, with every secret in text replaced by `mark` and n_chars (if there) counted again where that was done."""
    f, p = fresh(docs, "_f"), fresh(docs, "_parts")
    rows = with_findings(docs, forest, out=f, parts=p)
    new = f"concat(coalesce(get(`{f}`, i).head, ''), CASE WHEN get(`{f}`, i).score >= {threshold}D THEN {_sql(mark)} ELSE coalesce(get(`{f}`, i).secret, '') END)"
    whole = f"concat_ws('', transform(`{p}`, (p, i) -> concat(p, {new})))"
    hit = F.expr(f"exists(`{f}`, x -> x.score >= {threshold}D)")
    rows = rows.withColumn("text", F.when(hit, F.expr(whole)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(hit, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns))
