"""Secret scans: patterns, and Shannon entropy in sliding windows over candidate strings. DataFrame functions only.

Base kinds, leftmost and non-overlapping for each kind: ``assign`` (a name, a separator and 6 or more
characters), ``access`` (AKIA and 16 or more capitals or digits), ``hex`` (24 or more lower-case hex digits).

Entropy kinds: maximal runs of a character class (``entropy_hex``, ``entropy_base64``) of WINDOW or more
characters with a digit and a letter are candidates. A window slides over each; the counts of its characters are
kept up to date (one goes out, one comes in), and with them the sum of c*log2(c), so the entropy
``log2(WINDOW) - sum/WINDOW`` costs a constant for each step. The span runs from the first window at or
above the class's threshold to the end of the last one. Candidates on the allow list (placeholders, UUIDs,
plain numbers, alphabet runs) are suppressed.

Positions are code points, end exclusive. Defined results: null and empty texts have no spans and the
SHA-256 of the empty string; repeated rows give repeated results; an empty table gives none; ties in
start are ordered by kind. Everything is one projection: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 20
BLOCK = 64

#: kind, pattern, group whose length counts, least length.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: kind, pattern of a candidate, least entropy of a window in bits, letters of the class.
ENTROPY = (
    ("entropy_hex", r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{20,}(?![0-9A-Fa-f])", 3.0, "0123456789ABCDEFabcdef"),
    ("entropy_base64", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}", 3.6, "+-/0123456789=ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"),
)
#: Candidates that are no secrets.
ALLOW = r"(?i)example|sample|placeholder|dummy|changeme|xxxx|0123456789|1234567890|abcdefgh|^[0-9]+$|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|(.)\1{7}"
ORDER = [k[0] for k in (*BASE, *ENTROPY)]


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once (an expression used within a lambda is otherwise computed for every element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def starts(between: Column, lengths: Column) -> Column:
    """Start of each match, given the lengths of matches and of what is between them; two-level sums keep long lists near linear."""

    def place(x):
        """x: steps, and their sums by block."""

        def start(length, k):
            whole = F.floor(k / BLOCK).cast("int")
            return _sum(F.slice(x["blocks"], F.lit(1), whole)) + _sum(F.slice(x["steps"], whole * BLOCK + 1, k - whole * BLOCK)) + F.get(between, k)

        return F.transform(lengths, start)

    n = F.floor((F.size(lengths) - 1) / BLOCK).cast("int")
    sums = lambda steps: F.struct(steps.alias("steps"), F.transform(F.sequence(F.lit(0), n), lambda b: _sum(F.slice(steps, b * BLOCK + 1, BLOCK))).alias("blocks"))
    return let(let(F.transform(lengths, lambda m, k: m + F.get(between, k)), sums), place)


def _none() -> Column:
    return F.expr("cast(array() as array<struct<start:int,end:int,kind:int,text:string>>)")


def found(text: Column, pattern: str, kind: int, group: int, least: int) -> Column:
    """array<struct<start, end, kind, text>> of a pattern's matches; text is the group that counts."""
    lit = F.lit(pattern)
    all_of = lambda g: F.regexp_extract_all(text, lit, F.lit(g))

    def rows(x):
        length = F.transform(x["matches"], lambda m: F.length(m))
        between = F.transform(F.split(text, pattern, -1), lambda m: F.length(m))
        return let(F.struct(between.alias("between"), length.alias("length"), x["counted"].alias("counted")), lambda y: F.transform(
            F.arrays_zip(starts(y["between"], y["length"]).alias("s"), y["length"].alias("n"), y["counted"].alias("g")),
            lambda z: F.struct(z["s"].cast("int").alias("start"), (z["s"] + z["n"]).cast("int").alias("end"), F.lit(kind).alias("kind"), z["g"].alias("text")),
        ))

    matches = F.struct(all_of(0).alias("matches"), all_of(group).alias("counted"))
    return F.when(text.rlike(pattern), F.filter(let(matches, rows), lambda x: F.length(x["text"]) >= least)).otherwise(_none())


def window_span(text: Column, letters: str, least: float) -> Column:
    """struct<a, b>: first and last window of ``text`` with enough entropy (a is -1 if there is none)."""
    place = lambda c: F.instr(F.lit(letters), c)  # noqa: E731  counted from 1
    at = lambda k: place(F.substring(text, k, 1))
    plogp = lambda c: F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))
    first = F.transform(
        F.sequence(F.lit(1), F.lit(len(letters))), lambda i: F.length(F.substring(text, 1, WINDOW)) - F.length(F.replace(F.substring(text, 1, WINDOW), F.substring(F.lit(letters), i, 1), F.lit("")))
    )
    enough = lambda s: F.log2(F.lit(float(WINDOW))) - s / WINDOW >= least - 1e-9
    begin = let(let(first, lambda n: F.struct(n.alias("n"), F.aggregate(n, F.lit(0.0), lambda a, c: a + plogp(c)).alias("s"))), lambda x: F.struct(
        x["n"].alias("n"), x["s"].alias("s"), F.when(enough(x["s"]), 0).otherwise(-1).alias("a"), F.when(enough(x["s"]), 0).otherwise(-1).alias("b")
    ))

    def step(state, k):
        """Window k: the letter before it goes out, its last letter comes in."""
        return let(F.struct(at(k).alias("out"), at(k + WINDOW).alias("new")), lambda x: moved(state, k, x["out"], x["new"]))

    def moved(state, k, out, new):
        gone, come = F.element_at(state["n"], out), F.element_at(state["n"], new)
        s = F.when(out == new, state["s"]).otherwise(state["s"] - plogp(gone) + plogp(gone - 1) - plogp(come) + plogp(come + 1))
        n = F.transform(state["n"], lambda c, i: c - (i + 1 == out).cast("int") + (i + 1 == new).cast("int"))
        return let(s, lambda s: F.struct(
            n.alias("n"), s.alias("s"), F.when((state["a"] < 0) & enough(s), k).otherwise(state["a"]).alias("a"), F.when(enough(s), k).otherwise(state["b"]).alias("b")
        ))

    rest = F.when(F.length(text) > WINDOW, F.sequence(F.lit(1), F.length(text) - WINDOW)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.aggregate(rest, begin, step, lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b")))


def entropy_spans(text: Column, kind: int, pattern: str, least: float, letters: str) -> Column:
    """Spans of a class's candidates that hold a window of enough entropy."""
    wanted = F.filter(found(text, pattern, kind, 0, WINDOW), lambda x: x["text"].rlike("[0-9]") & x["text"].rlike("[A-Za-z]") & ~x["text"].rlike(ALLOW))
    measured = F.transform(wanted, lambda x: F.struct(x["start"].alias("start"), window_span(x["text"], letters, least).alias("w"), x["text"].alias("text")))
    return F.transform(
        F.filter(measured, lambda x: x["w"]["a"] >= 0),
        lambda x: F.struct(
            (x["start"] + x["w"]["a"]).alias("start"), (x["start"] + x["w"]["b"] + WINDOW).alias("end"), F.lit(kind).alias("kind"), F.substring(x["text"], x["w"]["a"] + 1, x["w"]["b"] - x["w"]["a"] + WINDOW).alias("text")
        ),
    )


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, ORDER))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"], x["end"])), ",")


def secret_spans(docs: DataFrame) -> DataFrame:
    """docs with ``base_spans`` and ``secret_spans``: arrays of (start, end, kind, text), by start, then kind."""
    clean = F.coalesce(F.col("text"), F.lit(""))
    base = F.array_sort(F.concat(*(found(clean, p, k, g, n) for k, (_, p, g, n) in enumerate(BASE))))
    more = F.concat(*(entropy_spans(clean, len(BASE) + k, p, h, c) for k, (_, p, h, c) in enumerate(ENTROPY)))
    return docs.withColumn("base_spans", base).withColumn("secret_spans", F.array_sort(F.concat("base_spans", more)))


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs with every span of text replaced by ``mask`` (overlapping spans by one); documents stay."""
    names = docs.columns
    rows = secret_spans(docs)

    def glue(state, x):
        """Take the text up to the span, then the mask, unless the span begins within the last one."""
        fresh = x["start"] >= state["at"]
        return F.struct(
            F.when(fresh, F.concat(state["parts"], F.array(F.substring(F.col("text"), state["at"] + 1, x["start"] - state["at"]), F.lit(mask)))).otherwise(state["parts"]).alias("parts"),
            F.greatest(state["at"], x["end"]).alias("at"),
        )

    begin = F.struct(F.expr("cast(array() as array<string>)").alias("parts"), F.lit(0).alias("at"))
    done = F.aggregate(F.col("secret_spans"), begin, glue, lambda s: F.concat(F.array_join(s["parts"], ""), F.substr(F.col("text"), s["at"] + 1)))
    return rows.withColumn("text", F.when(F.size("secret_spans") > 0, done).otherwise(F.col("text"))).select(*names)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secret_spans(common.texts(common.table(spark, sf_dir, "documents")))
    count = lambda k: F.size(F.filter("base_spans", lambda x: x["kind"] == k)).cast("long")
    return rows.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(written(F.col("base_spans")), 256).alias("base_sha256"), written(F.col("secret_spans")).alias("spans"),
    )
