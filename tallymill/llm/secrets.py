"""Secret scan: fixed patterns plus a character Markov model, in DataFrame functions only.

The base patterns find assignments, access keys and long hex runs. The method adds every other
run of token characters that looks more like a random string than like an ordinary identifier:
two first-order Markov models over characters, compared by log-likelihood ratio per transition.
Both are trained from labelled samples: what the base patterns found (random), and other words of
the corpus (ordinary). At most ``SAMPLE_DOCS`` documents of each kind, chosen by a hash of their id,
are read for training; their ids are chosen first, and only then are their texts read, so no texts
come together in a task. Every document is scanned. A run counts by its evidence per transition,
and must have as much in all as one of ``FULL`` characters at the threshold.

Positions come from the gaps between matches (``split`` with the same pattern): their code points,
summed. Offsets are in code points, end exclusive.

Cases: null and empty texts have no spans; rows without an id are scanned, but train no model; repeated rows are scanned each by itself; an empty
table gives an empty result; without any sample of one kind the method adds nothing.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.llm.storage import written

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
#: What the Markov models judge: runs of token characters.
RUN = r"[A-Za-z0-9+/_=-]{12,}"
FULL = 20
WORD = r"[A-Za-z0-9+/_=-]{4,}"
KINDS = ("assign", "access", "hex", "random")
SAMPLE_DOCS = 2000
#: Matches whose positions are added up at once, so that long texts with many stay linear.
BLOCK = 64
#: Letters, digits and the other token characters; one more class stands for the rest.
CLASSES = 128
#: Weight of a character's own frequency against that of its transition: a character that ordinary
#: words rarely have says little about the next one, and stays rare itself.
PRIOR = 500.0
#: Log-likelihood ratio per transition from which a run counts as a secret.
LEAST_RATIO = 1.0


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _found(text: Column, pattern: str, when: Column, group: int = 0) -> Column:
    """Array of (s, e, t): where ``pattern`` matches, and the text of ``group``; empty unless ``when``."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(matches)).alias("gap"), matches.alias("hit"), inner.alias("t"))
    none = F.expr("cast(array() as array<struct<s:int,e:int,t:string>>)")

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["gap"])
        e = s + F.length(x["hit"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["t"].alias("t")))).alias("out"))

    def block(part: Column) -> Column:
        return F.aggregate(part, F.struct(F.lit(0).alias("at"), none.alias("out")), step)

    def moved(x: Column, by: Column) -> Column:
        return F.struct((x["s"] + by).alias("s"), (x["e"] + by).alias("e"), x["t"].alias("t"))

    def joined(blocks: Column) -> Column:
        starts = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["at"])))
        return _let(starts, lambda by: F.flatten(F.transform(blocks, lambda x, i: F.transform(x["out"], lambda y: moved(y, F.get(by, i))))))

    def all_of(z: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / BLOCK).cast("int")), lambda i: block(F.slice(z, i * BLOCK + 1, F.lit(BLOCK))))
        return F.when(F.size(z) == 0, none).when(F.size(z) <= BLOCK, block(z)["out"]).otherwise(_let(parts, joined))

    return F.when(when, _let(zipped, all_of)).otherwise(none)


def _named(text: Column) -> Column:
    """May the assign pattern match? Most texts have none of its words."""
    lower = F.lower(text)
    named = lower.contains(ASSIGN_WORDS[0])
    for word in ASSIGN_WORDS[1:]:
        named = named | lower.contains(word)
    return named


def base_spans(docs: DataFrame, id_col: str, text_col: str, passed: list[str] | None = None) -> DataFrame:
    """doc_id, text, no_text, passed (other columns) and the arrays assign, access and hex of (s, e, t)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = _named(F.col("text"))
    other = F.struct(*(F.col(c) for c in passed)) if passed else F.lit(None)
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.col(text_col).isNull().alias("no_text"), other.alias("passed"))
    text = F.col("text")
    return base.select(
        "doc_id",
        "text",
        "no_text",
        "passed",
        F.filter(_found(text, ASSIGN, named, 2), lambda x: F.length(x["t"]) >= 6).alias("assign"),
        _found(text, ACCESS, text.contains("AKIA")).alias("access"),
        _found(text, HEX, text.rlike(HEX)).alias("hex"),
    )


def _codes(token: Column) -> Column:
    """The characters as numbers below CLASSES."""
    return F.transform(F.split(token, ""), lambda c: F.least(F.ascii(c), F.lit(CLASSES - 1)))


def _transitions(token: Column) -> Column:
    codes, n = _codes(token), F.length(token)
    return F.zip_with(F.slice(codes, 1, n - 1), F.slice(codes, 2, n - 1), lambda a, b: a * CLASSES + b + 1)


def _sampled_ids(ids: DataFrame, n_rows: int, n: int, spread: int) -> DataFrame:
    """At most n of the ids (doc_id), those with the smallest hashes; written.

    Looks at the ids below a share of the hashes that should hold enough of them, and at more of
    them as long as it doesn't.
    """
    share = spread * n / max(1, n_rows)
    while True:
        part = ids if share >= 1 else ids.where(F.xxhash64("doc_id") < int((share - 0.5) * 2.0**64))
        found = written(part.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n), "sampled-ids")
        if share >= 1 or found.count() >= n:
            return found
        share *= 8


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> list[float] | None:
    """Log-likelihood ratio of each character transition; None if a kind has no sample.

    Labels: strings that the base patterns find are random; other words of four characters and
    more, in a hash sample of all documents, are ordinary.
    """
    text = F.col(text_col)
    has_secret = (_named(text) & text.rlike(ASSIGN[:-2] + "{6,})")) | (text.contains("AKIA") & text.rlike(ACCESS)) | text.rlike(HEX)
    named = docs.where(F.col(id_col).isNotNull())
    n_rows = docs.count()
    chosen = _sampled_ids(named.where(has_secret).select(F.col(id_col).alias("doc_id")), n_rows, sample_docs, 64)
    random = base_spans(docs.join(F.broadcast(chosen.select(F.col("doc_id").alias(id_col))), id_col, "left_semi"), id_col, text_col)
    random = random.select(F.explode(F.transform(F.concat("assign", "access", "hex"), lambda x: x["t"])).alias("token"))
    chosen = _sampled_ids(named.select(F.col(id_col).alias("doc_id")), n_rows, sample_docs, 2)
    plain = docs.join(F.broadcast(chosen.select(F.col("doc_id").alias(id_col))), id_col, "left_semi")
    rest = F.col(text_col)
    for pattern in (ASSIGN, ACCESS, HEX):
        rest = F.regexp_replace(rest, pattern, " ")
    plain = plain.select(rest.alias("text")).select(F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("token"))
    both = random.withColumn("random", F.lit(1)).unionByName(plain.withColumn("random", F.lit(0)))
    pairs = both.where(F.length("token") >= 2).select("random", F.explode(_transitions(F.col("token"))).alias("pair"))
    counts: dict[int, dict[int, int]] = {0: {}, 1: {}}
    for row in pairs.groupBy("random", "pair").count().collect():  # at most 2 * CLASSES ** 2 rows
        counts[row["random"]][row["pair"] - 1] = row["count"]
    if not counts[0] or not counts[1]:
        return None
    used = sorted({p // CLASSES for c in counts.values() for p in c} | {p % CLASSES for c in counts.values() for p in c})
    ratio = [0.0] * CLASSES**2
    alone = {k: {b: sum(c.get(a * CLASSES + b, 0) for a in used) for b in used} for k, c in counts.items()}
    after = {k: {a: sum(c.get(a * CLASSES + b, 0) for b in used) for a in used} for k, c in counts.items()}
    for a in used:
        for b in used:
            p = {}
            for k, c in counts.items():  # a transition seen rarely goes by how often its second character is seen at all
                usual = (alone[k][b] + 0.5) / (sum(alone[k].values()) + 0.5 * len(used))
                p[k] = (c.get(a * CLASSES + b, 0) + PRIOR * usual) / (after[k][a] + PRIOR)
            ratio[a * CLASSES + b] = math.log(p[1] / p[0])
    return ratio


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, least_ratio: float = LEAST_RATIO, passed: list[str] | None = None) -> DataFrame:
    """doc_id, text, no_text, passed and spans: array of (kind, s, e, t), by start and then by kind as listed."""
    ratio = train(docs, id_col, text_col, sample_docs)
    found = base_spans(docs, id_col, text_col, passed)
    if ratio is None:
        found = found.withColumn("random", F.expr("cast(array() as array<struct<s:int,e:int,t:string>>)"))
    else:
        table = F.from_json(F.lit(json.dumps([round(x, 6) for x in ratio])), "array<double>")
        text = F.col("text")
        known = F.concat("assign", "access", "hex")

        def secret(x: Column) -> Column:
            total = F.aggregate(_transitions(x["t"]), F.lit(0.0), lambda acc, p: acc + F.element_at(table, p))
            return total >= least_ratio * F.greatest(F.length(x["t"]) - 1, F.lit(FULL - 1))

        found = found.withColumn("runs", _found(text, RUN, text.rlike(RUN)))
        found = found.withColumn("random", F.filter(F.filter("runs", lambda x: ~F.exists(known, lambda y: (y["s"] <= x["s"]) & (y["e"] >= x["e"]))), secret))
    return found.select("doc_id", "text", "no_text", "passed", F.array_sort(F.concat(*(_tagged(k) for k in KINDS))).alias("spans"))


def _tagged(kind: str) -> Column:
    """The spans of a kind with its number, ready to sort by start and kind."""
    return F.transform(kind, lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("kind"), x["e"].alias("e"), x["t"].alias("t")))


def masked_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "<SECRET>") -> DataFrame:
    """The documents with every span replaced in their text; overlapping spans become one.

    The columns other than id and text go along; a null text stays null.
    """
    passed = [c for c in docs.columns if c not in (id_col, text_col)]
    found = scan(docs, id_col, text_col, passed=passed)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        more = F.concat(acc["out"], F.substring("text", acc["at"] + 1, x["s"] - acc["at"]), F.lit(mask))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] >= acc["at"], more).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring("text", acc["at"] + 1, F.length("text"))))
    text = F.when(F.size("spans") > 0, whole).when(~F.col("no_text"), F.col("text"))
    out = {id_col: F.col("doc_id"), text_col: text} | {c: F.col(f"passed.{c}") for c in passed}
    return found.select(*(out[c].alias(c) for c in docs.columns))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["s"], x["e"])), ",")
