"""Secret scans: candidates by pattern, false positives removed by a random forest; DataFrame and SQL functions only.

Three patterns gather candidates: private-key blocks, values assigned to a name such as `token` or `password`, and long
runs of key characters. Each candidate is described by its length, how often its characters change class, how much of it
words of a dictionary cover, whether it looks like a path, and the words beside it. A random forest over these numbers
decides; it is trained on the driver from labelled findings and compiled into one SQL expression, so that scoring stays
inside the plan. The features of the training findings come from the same expressions as those of the documents.

No table of findings comes with the data, so `labelled_findings` makes them by rule: secrets in the formats and contexts
of common leaks, and what patterns mistake for them (digests, identifiers, paths, long words, numbers, placeholders).
Findings of one's own can be given instead.
"""

from __future__ import annotations

import random
import string
import uuid

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .trees import Node, forest
from .workspace import carried, restored

#: Names that secrets are assigned to, as a pattern.
NAMES = r"(?i:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|credential)"
CANDIDATE = (
    r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}+-----END [A-Z ]{0,24}PRIVATE KEY-----"
    rf"|(?<![A-Za-z0-9_.-])(?>[A-Za-z0-9_.-]*)(?=[\x22\x27]?\s{{0,4}}[:=])(?<={NAMES})[\x22\x27]?\s{{0,4}}[:=]\s{{0,4}}[\x22\x27]?[^\s\x22\x27<>,;]{{6,}}"
    rf"|{NAMES}[\x22\x27]?\s{{0,4}}[:=]\s{{0,4}}[\x22\x27]?[^\s\x22\x27<>,;]{{6,}}"
    r"|[A-Za-z0-9_+/=-]{16,}(?:\.[A-Za-z0-9_-]{10,}){0,2}"
)
_VALUE = r"(?s)^(?!-----)[^:=]{2,}?[:=]\s{0,4}[\x22\x27]?([^\s\x22\x27<>,;]{6,})$"
#: Common words and word parts that make up identifiers and prose.
DICTIONARY = (
    "able access account action address admin after agent album amount and answer apple array article author back base before begin big block board body book box build button call car case cell change char check child city class clean click client close cloud code color column command comment company config connect content control copy count cover create data date day debug default delete detail device dir document domain down draw drive edit element email end engine enter error event example extra field file filter find first float folder form format frame free from function game get global good graph green group hand handle head header height help high home host house image index info init input int item job key kind label language large last layer left length level library light limit line link list load local lock log long loop main make manager map mark master match max media member memory menu message method min model module month move name net new next node note number object off open option order out output owner page paper parent part path people phone place plan point port post power price print private process product profile project property public query question read record ref region release remote render report request reset resource response rest result return right role root row rule run sample save schema scope screen script search section select send sequence series server service session set shape share short show side sign simple site size small sort sound source space start state status step stop store stream string style sub support switch system table tag target task team temp test text the theme thing this time title token tool total track train tree type unit update upload upper url user util valid value version video view visit voice wait walk water web week white width window word work world write year zone"
    " tion ment ness ing ity ous ver ten lich keit heit schen ung eur eux que ción ado ent ant ist ble ther here ation"
).split()
FEATURES = (
    "length", "changes", "digits", "uppers", "lowers", "others", "hexadecimal", "distinct", "vowels", "dictionary", "slashes",
    "path_before", "named", "near_name", "near_digest", "assigned", "quoted", "known_prefix", "placeholder", "block",
)


def _quoted(pattern: str) -> str:
    """A pattern as a raw SQL literal; patterns here spell quotes as \\x22 and \\x27."""
    assert "'" not in pattern
    return f"r'{pattern}'"


def candidates_column(text: str) -> list[tuple[str, str]]:
    """Steps (column, SQL) that end in __found: an array of candidates with their features; every step is a column."""
    share = lambda chars: f"length(regexp_replace(c.v, {_quoted(f'[^{chars}]')}, '')) / length(c.v)"
    flag = lambda on, pattern: f"double(rlike({on}, {_quoted(pattern)}))"
    words = "|".join(sorted({w for w in DICTIONARY if len(w) > 2}, key=lambda w: (-len(w), w)))
    classes = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(c.v, '[a-z]', 'a'), '[A-Z]', 'B'), '[0-9]', '0'), '[^aB0]', '.')"
    features = {
        "length": "double(length(c.v))",
        "changes": f"(length(regexp_replace({classes}, {_quoted(r'(.)\1+')}, '$1')) - 1) / length(c.v)",
        "digits": share("0-9"),
        "uppers": share("A-Z"),
        "lowers": share("a-z"),
        "others": f"1 - ({share('A-Za-z0-9')})",
        "hexadecimal": flag("c.v", "^([0-9a-f]+|[0-9A-F]+)$"),
        "distinct": "double(size(array_distinct(split(c.v, ''))))",
        "vowels": share("aeiouAEIOU"),
        "dictionary": f"1 - length(regexp_replace(lower(c.v), {_quoted(words)}, '')) / length(c.v)",
        "slashes": f"double(length(regexp_replace(c.v, {_quoted('[^/]')}, '')))",
        "path_before": flag("c.l", r"(://|[\w.-]/|\.\./|[a-z]:\\)[^\s]*$"),
        "named": flag("c.l", rf"{NAMES}[\x22\x27]?\s{{0,4}}[:=]\s{{0,4}}[\x22\x27]?$"),
        "near_name": flag("c.l", rf"({NAMES}|bearer|authorization|signing|credentials?)\b"),
        "near_digest": flag("concat(c.l, c.r)", r"\b(commit|revision|rev|sha-?\d*|md5|checksum|digest|hash|uuid|guid|etag|integrity|build|base64|isbn|order|invoice|id)\b"),
        "assigned": flag("c.l", r"[:=]\s{0,4}[\x22\x27]?$"),
        "quoted": rf"double(rlike(c.l, {_quoted(r'[\x22\x27]$')}) AND rlike(c.r, {_quoted(r'^[\x22\x27]')}))",
        "known_prefix": flag("c.v", r"^(AKIA|ASIA|gh[pousr]_|sk_live_|sk-|xox[abprs]-|AIza|eyJ|glpat-)"),
        "placeholder": flag("lower(c.v)", r"example|sample|your|change_?me|placeholder|dummy|redacted|xxxx|\*\*\*|\$\{|(.)\1{7,}"),
        "block": flag("c.v", r"^-----BEGIN"),
    }
    fields = ", ".join(f"'{k}', double({features[k]})" for k in FEATURES)
    return [
        ("__matches", f"regexp_extract_all(coalesce({text}, ''), {_quoted(CANDIDATE)}, 0)"),
        ("__gaps", f"split(coalesce({text}, ''), {_quoted(CANDIDATE)}, -1)"),
        ("__cut", f"transform(__matches, (m, i) -> named_struct('m', m, 'v', coalesce(nullif(regexp_extract(m, {_quoted(_VALUE)}, 1), ''), m), 'i', i))"),
        ("__around", "transform(__cut, c -> named_struct('m', c.m, 'v', c.v, 'l', lower(right(concat(right(__gaps[c.i], 64), left(c.m, length(c.m) - length(c.v))), 64)), 'r', lower(left(__gaps[c.i + 1], 24))))"),
        ("__found", f"transform(__around, c -> named_struct('m', c.m, 'v', c.v, {fields}))"),
    ]


def with_candidates(docs: DataFrame, text_col: str) -> DataFrame:
    """`docs` with __matches, __gaps and __found. Steps are columns of their own, so that none is computed twice."""
    for name, sql in candidates_column(f"`{text_col}`"):
        docs = docs.withColumn(name, F.expr(sql))
    return docs.drop("__cut", "__around")


def labelled_findings(n: int = 4000, seed: int = 11) -> list[tuple[str, str, str, int]]:
    """(before, value, after, is a secret) by rule; n is the bound of the training sample."""
    rng = random.Random(seed)
    pick = lambda chars, k: "".join(rng.choices(chars, k=k))
    alnum, key = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    syllables = [a + b for a in "bdfghklmnprstvw" for b in ("a", "e", "i", "o", "u", "an", "er", "in", "or", "ch", "st")]
    syllables += ["the", "tion", "ing", "ver", "keit", "lich", "schen", "heit", "ung", "ment", "eux", "que", "ción", "ble"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    prose = lambda: " ".join(word() for _ in range(rng.randint(1, 7)))
    names = ["token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "api-key", "access_key", "auth_key", "TOKEN", "SECRET", "API_KEY", "PASSWORD", "Token"]
    hexes = ("0123456789abcdef", "0123456789ABCDEF")
    ident = lambda sep: sep.join(rng.choice(DICTIONARY) for _ in range(rng.randint(3, 6)))

    def assignment() -> tuple[str, str]:
        quote = rng.choice(['"', '"', "'", ""])
        return f"{rng.choice(names)}{rng.choice(['', '', chr(34)]) if quote else ''}{rng.choice([' = ', '=', ': ', ':'])}{quote}", quote

    def secret() -> tuple[str, str, str]:
        which = rng.random()
        before, after = assignment()
        if which < 0.45:
            return before, pick(rng.choice(hexes), rng.choice([32, 40, 40, 48, 64])), after
        if which < 0.6:
            return before, pick(key, rng.randint(20, 64)), after
        if which < 0.75:
            return before, pick(alnum + "!#%&@_-", rng.randint(8, 20)), after
        if which < 0.82:
            return rng.choice(["Authorization: Bearer ", "bearer ", "credentials "]), pick(alnum + "_-", rng.randint(24, 60)), ""
        if which < 0.97:
            made = rng.choice(["AKIA" + pick(string.ascii_uppercase + string.digits, 16), "ghp_" + pick(alnum, 36), "sk_live_" + pick(alnum, 24), "xoxb-" + pick(string.digits, 12) + "-" + pick(alnum, 24), "AIza" + pick(alnum + "_-", 35), "eyJ" + pick(alnum, 20) + "." + pick(alnum, 30) + "." + pick(alnum, 27)])
            return rng.choice([before, "", "key ", "see "]), made, after
        return "", f"-----BEGIN {rng.choice(['RSA ', 'EC ', ''])}PRIVATE KEY-----\n{pick(key, 64)}\n{pick(key, 40)}==\n-----END {rng.choice(['RSA ', 'EC ', ''])}PRIVATE KEY-----", ""

    def other() -> tuple[str, str, str]:
        which = rng.random()
        before, after = assignment()
        if which < 0.25:
            long = "".join(word() for _ in range(8))[: rng.randint(16, 30)]
            return "", rng.choice([long, long.capitalize(), long.upper()]), rng.choice(["", ".", ","])
        if which < 0.4:
            return rng.choice(["commit ", "revision ", "sha1 ", "sha256:", "md5 = ", "checksum: ", "digest=", "etag: ", "hash: ", "integrity "]), pick(hexes[0], rng.choice([32, 40, 64])), ""
        if which < 0.48:
            return rng.choice(["id: ", "uuid=", "", "order "]), str(uuid.UUID(int=rng.getrandbits(128))), ""
        if which < 0.62:
            return rng.choice(["", "https://" + word() + ".org", "import ", "see ", "file "]), "/" + ident("/") + rng.choice(["", "/" + word()]), rng.choice(["", ".py", ".html"])
        if which < 0.74:
            return rng.choice(["", before, "def ", "call "]), rng.choice([ident("_"), ident("-"), "".join(w.capitalize() for w in ident("_").split("_"))]), after
        if which < 0.84:
            return rng.choice(["", "card ", "phone ", "no. ", "isbn "]), pick(string.digits, rng.choice([16, 16, 17, 20])), ""
        if which < 0.92:
            return before, rng.choice(["your_api_key_here", "changeme_changeme", "example-token-value", "xxxxxxxxxxxxxxxxxxxx", "placeholder_value", "${API_TOKEN_VALUE}", "****************", "dummy_password", "none_at_all_here", word() + word()]), after
        if which < 0.97:
            return "", rng.choice("=-_+") * rng.randint(16, 60), ""
        return "data:image/png;base64,", pick(key, rng.randint(80, 200)), ""

    out = []
    for i in range(n):
        before, value, after = (secret if i % 2 else other)()
        out.append((f"{prose()} {before}", value, f"{after} {prose()}", i % 2))
    return out


def featurize(spark, findings: list[tuple[str, str, str, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of findings; those that the patterns don't gather as given are left out."""
    rows = spark.createDataFrame([(b + v + a, v, y) for b, v, a, y in findings], "text string, value string, y int")
    found = with_candidates(rows, "text").select("y", "value", F.explode("__found").alias("c")).where("c.v = value").select("y", *[f"c.{f}" for f in FEATURES])
    table = np.array([tuple(r) for r in found.collect()], dtype=np.float64).reshape(-1, len(FEATURES) + 1)
    table = table[np.lexsort(table.T)]
    return table[:, 1:], table[:, 0].astype(np.int64)


def forest_sql(trees: list[Node], struct: str) -> str:
    """The mean of the trees' leaf values as SQL over a struct of FEATURES."""

    def one(node: Node) -> str:
        if node.feature < 0:
            return f"{round(node.value, 4)}D"
        return f"IF({struct}.{FEATURES[node.feature]} <= {node.threshold!r}D, {one(node.left)}, {one(node.right)})"

    return f"({' + '.join(one(t) for t in trees)}) / {len(trees)}D"


_forests: dict[tuple[int, int, int], list[Node]] = {}


def default_forest(spark, trees: int = 24, depth: int = 7, n: int = 4000) -> list[Node]:
    """A forest trained on `n` rule-made findings; it is the same in every session."""
    if (trees, depth, n) not in _forests:
        _forests[trees, depth, n] = forest(*featurize(spark, labelled_findings(n)), trees, depth, leaf=3, seed=5, tries=6)
    return list(_forests[trees, depth, n])


def _judged(docs: DataFrame, text_col: str, model: list[Node] | None) -> DataFrame:
    """`docs` with __matches, __gaps and __scores (a score for each match)."""
    model = model or default_forest(docs.sparkSession)
    # A text without a candidate has an empty array, for which nothing is evaluated.
    return with_candidates(docs, text_col).withColumn("__scores", F.expr(f"transform(__found, c -> {forest_sql(model, 'c')})"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: list[Node] | None = None, threshold: float = 0.5) -> DataFrame:
    """A row for each secret: doc_id, start (code points before it), length, secret, score, n_candidates.

    Null and empty texts have none; repeated rows give their findings each; rows without an id give theirs with a null id.
    Other columns are not looked at. An empty table gives no rows.
    """
    rows = _judged(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), "text", model)
    rows = rows.where(F.expr(f"exists(__scores, s -> s >= {threshold}D)")).withColumn("__row", F.monotonically_increasing_id())
    each = rows.select("doc_id", "__row", F.size("__found").alias("n_candidates"), F.posexplode(F.expr("transform(__found, (c, i) -> named_struct('v', c.v, 'n', length(c.m), 'gap', length(__gaps[i]), 'score', __scores[i]))")).alias("at", "c"))
    before = Window.partitionBy("__row").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ends = each.withColumn("__end", F.sum(F.col("c.gap") + F.col("c.n")).over(before)).where(F.col("c.score") >= threshold)
    return ends.select("doc_id", (F.col("__end") - F.length("c.v")).cast("long").alias("start"), F.length("c.v").cast("long").alias("length"), F.col("c.v").alias("secret"), F.round("c.score", 6).alias("score"), "n_candidates")


def redact_secrets(docs: DataFrame, text_col: str = "text", model: list[Node] | None = None, threshold: float = 0.5, mask: str = "[SECRET]") -> DataFrame:
    """`docs` with the secrets in its texts replaced by `mask`, and all other columns as they are, whatever their names.

    Null texts stay null, empty ones and those without secrets as they are; repeated rows come out as often as they come in.
    An empty table gives no rows.
    """
    rows = _judged(carried(docs, text=text_col), "text", model)
    clean = F.expr(
        "array_join(transform(__gaps, (g, i) -> concat(g, CASE WHEN i >= size(__matches) THEN '' "
        f"WHEN __scores[i] >= {threshold}D THEN concat(left(__matches[i], length(__matches[i]) - length(__found[i].v)), '{mask}') ELSE __matches[i] END)), '')"
    )
    hit = F.expr(f"exists(__scores, s -> s >= {threshold}D)")
    return rows.withColumn("text", F.when(hit, clean).otherwise(F.col("text"))).select(*restored(docs, text=text_col))


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Every secret in all documents, by position, with its digest in place of its text; odd rows as in `scan_secrets`."""
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "start", "length", F.sha2("secret", 256).alias("secret_sha256"), "score", "n_candidates")
