"""Personal data by fixed patterns, and by context patterns bootstrapped from what they find.

Only DataFrame and SQL functions are used.  *Base* spans are the matches of four patterns (``KINDS``), leftmost and
not overlapping for each kind, that pass the kind's check; a match that fails is dropped.  The patterns are written so
that Java's engine takes them in linear time without recursion, with equal matches.

The method then adds spans.  Words with a digit or an `@` are *instances*; the one or two words before an instance and
the word after it are its *patterns*; all texts give the graph of pattern-instance pairs.  Instances in base spans are
seeds with score 1, as are long mixed strings of letters and digits (``SECRET``), seeds of a kind `secret` that isn't in
the base.  In each round a pattern's confidence for a kind is the mean score of its distinct instances, and counts only
from ``SUPPORT`` and ``CONFIDENCE`` on; an instance's score is 1 - product(1 - confidence) over its patterns.  Rounds go
on until no pattern joins; the set only grows.  What stands at a confident pattern and looks roughly like its kind
(``_LIKE``) becomes a span of that kind, unless base spans overlap it: numbers that miss a kind's exact form, and
secrets of any form where secrets stand.  Seeds of `secret` without a confident pattern aren't spans.  Base spans stay.

Texts are read once, into a table without them (spans and instances of each row); the graph, its scores and the result
come from that table.  Frequent patterns are counted with map-side sums.  The confident patterns and the added spans
are broadcast only if they're counted to be few.

A null text is empty.  Equal rows get equal spans, as do rows with a null id.  An empty table gives an empty one.  Other
columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exchange import saved, small_or_not
from .spans import NO_ID, keyed

KINDS = ("email", "ip", "card", "phone")
#: The kinds of all spans, in their order.
SPAN_KINDS = (*KINDS, "secret")
SUPPORT, CONFIDENCE = 5.0, 0.7
SECRET = "^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/_-]{32,}$"
#: Elements of an array that are summed up together.
_BLOCK = 512

_NAME = "[A-Za-z0-9._%+-]"
_PATTERNS = {
    "email": rf"(?:(?<!{_NAME})|\G){_NAME}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_MARKS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_INSTANCE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

_SPANS = "array<struct<kind:string,start:int,stop:int>>"
_FOUND = "array<struct<start:int,stop:int,word:string,kind:string,near:string,far:string,next:string>>"


def _starts(steps: Column) -> Column:
    """The sum of all steps before each; in blocks, so a long array costs little more than its length."""
    n = F.size(steps)

    def block(b: Column) -> Column:
        before = F.aggregate(F.slice(steps, F.lit(1), b * _BLOCK), F.lit(0), lambda a, x: a + x)
        empty = F.struct(before.alias("sum"), F.array().cast("array<int>").alias("all"))
        own = F.slice(steps, b * _BLOCK + 1, F.lit(_BLOCK))
        return F.aggregate(own, empty, lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["all"], F.array(a["sum"])).alias("all")), lambda a: a["all"])

    last = F.floor((n - 1) / _BLOCK).cast("int")
    return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(0), last), block))).otherwise(F.array().cast("array<int>"))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substring(digits, n - i, F.lit(1))) - 48
        double = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, double).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


_CHECKS: dict[str, Callable[[Column], Column]] = {
    "email": lambda text: F.lit(True),
    "ip": lambda text: text.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
    "card": lambda text: F.length(_digits(text)).between(13, 19) & _luhn(_digits(text)),
    "phone": lambda text: F.length(_digits(text)).between(9, 15),
}


#: What an instance must look like to become a span of a kind.
_LIKE: dict[str, Callable[[Column], Column]] = {
    "email": lambda word: word.contains("@"),
    "ip": lambda word: word.rlike(r"^[0-9A-Fa-f]+(?:[.:]+[0-9A-Fa-f]+){2,}$"),
    "card": lambda word: word.rlike("^[0-9 -]+$") & (F.length(_digits(word)) >= 12),
    "phone": lambda word: word.rlike("^[0-9 ().+-]+$") & F.length(_digits(word)).between(6, 15),
    "secret": lambda word: word.rlike("^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/_-]{8,}$"),
}


def _with_matches(rows: DataFrame, name: str, pattern: str, possible: Column) -> DataFrame:
    """``name``: array of (start, stop, text, gap, rest) of the pattern's matches; the text since the match before, and to the next.

    Positions are in characters: what the pattern splits off gives the lengths between the matches.
    """
    none = F.array().cast("array<string>")
    rows = rows.withColumn("_found", F.when(possible, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))
    rows = rows.withColumn("_gaps", F.when(F.size("_found") > 0, F.split("text", pattern, -1)).otherwise(none))
    rows = rows.withColumn("_steps", F.zip_with("_found", F.slice("_gaps", F.lit(1), F.size("_found")), lambda x, gap: F.length(x) + F.length(gap)))
    rows = rows.withColumn("_starts", _starts(F.col("_steps")))

    def made(start: Column, i: Column) -> Column:
        x, gap = F.get("_found", i), F.get("_gaps", i)
        at = start + F.length(gap)
        return F.struct(at.alias("start"), (at + F.length(x)).alias("stop"), x.alias("text"), gap.alias("gap"), F.get("_gaps", i + 1).alias("rest"))

    return rows.withColumn(name, F.transform("_starts", made)).drop("_found", "_gaps", "_steps", "_starts")


def _base(rows: DataFrame) -> DataFrame:
    """Adds ``base``, the base spans by kind and start."""
    digit = F.col("text").rlike("[0-9]")
    for kind in KINDS:
        possible = F.col("text").contains(_MARKS[kind])
        rows = _with_matches(rows, f"_{kind}", _PATTERNS[kind], possible if kind == "email" else possible & digit)

    def checked(kind: str) -> Column:
        right = F.filter(f"_{kind}", lambda x: _CHECKS[kind](x["text"]))
        return F.transform(right, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop")))

    arrays = [checked(kind) for kind in KINDS]
    return rows.withColumn("base", F.concat(*arrays).cast(_SPANS)).drop(*(f"_{kind}" for kind in KINDS))


def _instances(rows: DataFrame) -> DataFrame:
    """Adds ``found``: the instances, with the kind of the base span that begins in them and the words around them."""
    rows = _with_matches(rows, "_words", _INSTANCE, F.col("text").rlike("[0-9@]"))

    def described(x: Column, i: Column) -> Column:
        lead = F.length(F.regexp_extract(x["text"], "^[^A-Za-z0-9+@]*", 0))
        bare = F.regexp_extract(x["text"], r"^[^A-Za-z0-9+@]*+(.*?)[^A-Za-z0-9]*$", 1)
        start = x["start"] + lead
        stop = start + F.length(bare)
        heads = F.filter("base", lambda b: (b["start"] >= x["start"]) & (b["start"] < x["stop"]))
        head = F.get(heads, F.lit(0))
        over = F.exists("base", lambda b: (b["start"] < x["stop"]) & (b["stop"] > x["start"]))
        kind = F.when(F.size(heads) > 0, head["kind"]).when(over, F.lit("-")).when(bare.rlike(SECRET), F.lit("secret"))
        word = F.when(F.size(heads) > 0, F.substring("text", head["start"] + 1, head["stop"] - head["start"])).otherwise(bare)
        near = F.regexp_extract(x["gap"], r"(?<!\S)(\S++)\s++$", 1)
        far = F.regexp_replace(F.regexp_extract(x["gap"], r"(?<!\S)(\S++\s++\S++)\s++$", 1), r"\s+", " ")
        after = F.regexp_extract(x["rest"], r"^\s++(\S++)", 1)
        return F.struct(
            start.alias("start"), stop.alias("stop"), word.alias("word"), kind.alias("kind"),
            *(F.nullif(F.lower(side), F.lit("")).alias(name) for name, side in (("near", near), ("far", far), ("next", after))),
        )

    return rows.withColumn("found", F.transform("_words", described).cast(_FOUND)).drop("_words")


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, stamp, base, found) of every row, as a table."""
    rows = keyed(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    return saved(_instances(_base(rows)).select("doc", "stamp", "base", "found"), "private")


def _contexts(read: DataFrame) -> DataFrame:
    """(doc, stamp, start, stop, word, kind, pattern): a row for each instance and each pattern around it."""
    x = read.where(F.size("found") > 0).select("doc", "stamp", F.explode("found").alias("x")).select("doc", "stamp", "x.*")
    x = x.where(~F.col("kind").eqNullSafe("-") & (F.length("word") > 0))
    return x.withColumn("pattern", F.explode(F.array_compact(F.array("near", "far", F.concat(F.lit("* "), "next"))))).drop("near", "far", "next")


def confident_patterns(contexts: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(pattern, kind, confidence) after scoring the graph of patterns and instances to a fixed point."""
    edges = saved(contexts.groupBy("pattern", "word").agg(F.max("kind").alias("kind")), "graph")
    totals = edges.groupBy("pattern").agg(F.count("*").alias("total"))
    seeds = edges.where("kind is not null").groupBy("word", "kind").agg(F.lit(1.0).alias("score"))
    scores, patterns, n = seeds, None, -1
    while True:
        sums = edges.select("pattern", "word").join(scores, "word").groupBy("pattern", "kind").agg(F.sum("score").alias("sum")).where(F.col("sum") >= support)
        confident = sums.join(totals, "pattern").withColumn("confidence", F.col("sum") / F.col("total")).where(F.col("confidence") >= confidence)
        patterns = saved(confident.select("pattern", "kind", "confidence"), "patterns")
        before, n = n, patterns.count()
        if n == before or not n:
            return patterns
        doubt = F.sum(F.log(1.0 - F.least("confidence", F.lit(0.99))))
        new = edges.where("kind is null").select("pattern", "word").join(small_or_not(patterns), "pattern").groupBy("word", "kind").agg((1.0 - F.exp(doubt)).alias("score"))
        scores = seeds.unionByName(new).groupBy("word", "kind").agg(F.max("score").alias("score"))


def _added(read: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc, stamp, more): the spans that confident patterns add."""
    new = _contexts(read).where("kind is null or kind = 'secret'").drop("kind")
    like = F.lit(False)
    for kind in SPAN_KINDS:
        like = like | ((F.col("kind") == kind) & _LIKE[kind](F.col("word")))
    best = new.join(small_or_not(patterns), "pattern").where(like).groupBy("doc", "stamp", "start", "stop").agg(F.max(F.struct("confidence", "kind")).alias("best"))
    return best.groupBy("doc", "stamp").agg(F.collect_list(F.struct(F.col("best.kind").alias("kind"), "start", "stop")).cast(_SPANS).alias("more"))


def _ordered(spans: Column) -> Column:
    """By kind, as listed, then start."""
    rank = F.transform(spans, lambda x: F.struct(F.array_position(F.array(*map(F.lit, SPAN_KINDS)), x["kind"]).alias("rank"), x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind")))
    return F.transform(F.array_sort(rank), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop")))


def _spans(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc, stamp, base) of every row; (doc, stamp, more) of those with added spans."""
    read = _read(docs, id_col, text_col)
    patterns = confident_patterns(_contexts(read))
    return read.select("doc", "stamp", "base"), saved(_added(read, patterns), "added")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans) of every row: arrays of (kind, start, stop) in characters, by kind and start."""
    read, added = _spans(docs, id_col, text_col)
    rows = read.join(small_or_not(added), ["doc", "stamp"], "left")
    spans = F.concat("base", F.coalesce("more", F.array().cast(_SPANS)))
    return rows.select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "base", _ordered(spans).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with each found span replaced by its kind in brackets, overlapping ones by the first's kind."""
    _, added = _spans(docs, id_col, text_col)
    names = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{x}`") for x in names]).alias("row"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("doc"), F.col(f"`{text_col}`").alias("text"))
    row = row.withColumn("stamp", F.xxhash64("text"))
    row = _base(row.join(small_or_not(added), ["doc", "stamp"], "left"))
    by_start = F.array_sort(F.transform(F.concat("base", F.coalesce("more", F.array().cast(_SPANS))), lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind"))))
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))

    def cut(a: Column, x: Column) -> Column:
        apart = x["start"] >= a["at"]
        text = F.when(apart, F.concat(a["text"], F.substring("text", a["at"] + 1, x["start"] - a["at"]), F.lit("["), x["kind"], F.lit("]"))).otherwise(a["text"])
        return F.struct(text.alias("text"), F.greatest(a["at"], x["stop"]).alias("at"))

    done = F.aggregate(by_start, start, cut, lambda a: F.concat(a["text"], F.substring("text", a["at"] + 1, F.length("text"))))
    clean = F.when(F.size(by_start) > 0, done).otherwise(F.col("text"))
    row = row.withColumn("clean", clean)
    return row.select(*[F.col("clean").alias(x) if x == text_col else F.col(f"row.`{x}`") for x in names])


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns of ``find``."""

    def joined(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return result.select("doc_id", *map(count, KINDS), F.sha2(F.encode(joined("base"), "utf-8"), 256).alias("base_sha256"), joined("spans").alias("spans"))
