"""Benchmark decontamination by template canonicalisation, in DataFrame functions alone.

Numbers, names and units become typed placeholders, word for word, so that a question asked again
with other values has the same template. Documents' template windows are hash-joined with those of
the benchmark items. Benchmark windows start at every word and documents' at every ``stride``-th, which
still hits each common run of ``window + stride - 1`` words. The join sees slim rows of hash and place.
Its hits are gathered by alignment (document, item, distance of their places), and only then are the
two texts fetched: an alignment is compared word by word once, whatever its number of hits, and the
values in its slots must correspond one to one.

Three templates are tried, which differ in names: capitalised words that start no sentence; none, for
copies in another case; and all capitalised words, for names at the start of sentences, after quotes
or brackets, in capitals or with inner capitals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.scratch import Scratch, unused

WINDOW = 8
STRIDE = 6
#: Words that a document and an item must have in common in one piece.
RUN = WINDOW + STRIDE - 1
#: Identical words in one piece that are a match whatever the rest of the alignment holds.
VERBATIM = 2 * RUN
#: Benchmark words up to which its windows are broadcast, three rows of about 50 bytes each; beyond, Spark shuffles both sides.
BROADCAST_WORDS = 400_000

# Units of measure that become a placeholder after a number.
UNITS = (
    "mm|cm|dm|km|m|meters?|metres?|miles?|feet|foot|ft|inches|inch|yards?|mg|kg|g|grams?|kilograms?|tons?|tonnes?|pounds?|lbs?|ounces?|oz"
    "|ml|cl|l|liters?|litres?|gallons?|seconds?|sec|minutes?|min|hours?|hrs?|days?|weeks?|months?|years?|percent|degrees?|dollars?|euros?|cents?|mph|kmh|watts?|volts?"
)
_NUMBER = r"[+-]?[$€£]?\d[\d.,:/]*%?"


def once(value: Column) -> Column:
    """The value as the only row of a generator, so that no later expression computes it again."""
    return F.explode(F.array(value))


# Template forms, by what is a name.
MID, NO_NAMES, CAPITALISED = 0, 1, 2
#: The words themselves, without case and edge punctuation, for items under RUN words.
PLAIN = 3
FORMS = (MID, NO_NAMES, CAPITALISED)
# Noncharacters that mark names of the first form and of the third ahead of the word, and punctuation.
_MARK, _CAP = "\ufdd0", "\ufdd1"
_END = r"(?=[^\p{L}\d ]*(?![^ ]))"
_MID_NAME = rf" (?<=[\p{{Ll}}\d,;>] )(\p{{Lu}}\p{{Ll}}+){_END}"
_CAP_NAME = rf" ([^\p{{L}}\p{{N}}<> ]*\p{{Lu}}[\p{{L}}\p{{M}}\p{{N}}'’.&-]*){_END}"


def spaced(text: Column) -> Column:
    """The text with one blank before, between and after its words; the marks become punctuation."""
    t = F.regexp_replace(F.concat(F.lit(" "), text, F.lit(" ")), r"[\x20\x09-\x0D]+", " ")
    return F.replace(F.replace(t, F.lit(_MARK), F.lit("~")), F.lit(_CAP), F.lit("~"))


def numbered(t: Column) -> Column:
    """:func:`spaced` text with placeholders for numbers and units."""
    # "<" and ">" are for placeholders: a word of nothing else keeps its place
    t = F.regexp_replace(t, r" [<>]+(?= )", " ~")
    t = F.replace(F.replace(t, F.lit("<"), F.lit("")), F.lit(">"), F.lit(""))
    t = F.regexp_replace(t, rf" {_NUMBER}(?i:{UNITS})?{_END}", " <num>")
    return F.regexp_replace(t, rf"<num> (?i:{UNITS}){_END}", "<num> <unit>")


def marked(text: Column) -> Column:
    """The text in lower case, with placeholders, names marked and "~" for punctuation."""
    t = F.regexp_replace(numbered(spaced(text)), _MID_NAME, f" {_MARK}$1")
    t = F.regexp_replace(t, _CAP_NAME, f" {_CAP}$1")
    return F.regexp_replace(F.lower(t), rf"[^\p{{L}}\p{{N}}<> {_MARK}{_CAP}]+", "~")


def template_words(t: Column, form: int) -> Column:
    """The words of one template form of :func:`marked` text, with an empty one at either end.

    A word is its letters and digits or a placeholder; one of punctuation alone is empty and keeps its place.
    """
    if form != NO_NAMES:  # a name of the first form has both marks, the third form's ahead
        t = F.regexp_replace(t, f"{_CAP}{_MARK if form == MID else ''}[^ ]*", "<name>")
    for mark in ("~", _MARK, _CAP):
        t = F.replace(t, F.lit(mark), F.lit(""))
    return F.split(t, " ")


def plain_words(text: Column) -> Column:
    """The words themselves, in lower case and without punctuation around them, with an empty one at either end."""
    return F.split(F.regexp_replace(F.lower(spaced(text)), r"(?<= )[^\p{L}\p{N} ]+|[^\p{L}\p{N} ]+(?= )", ""), " ")


def words_of(df: DataFrame, text: Column, plain: bool, *keep: str) -> DataFrame:
    """The columns ``keep`` and ``w0`` to ``w2``, the words of each form; ``w3``, the plain ones, if asked for."""
    df = df.select(*keep, text.alias("_text"), once(marked(text)).alias("_marked"))
    forms = [template_words(F.col("_marked"), f).alias(f"w{f}") for f in FORMS]
    if plain:
        forms.append(plain_words(F.col("_text")).alias(f"w{PLAIN}"))
    return df.select(*keep, once(F.struct(*forms)).alias("_forms")).select(*keep, "_forms.*")


def count_of(words: Column) -> Column:
    """The number of words between the empty ends; null texts have none."""
    return F.coalesce(F.size(words), F.lit(2)) - 2


def value(kind: Column, word: Column) -> Column:
    """A slot's value without case and without punctuation around it; a number keeps its sign, currency and percent."""
    number = F.regexp_replace(word, r"^[^\p{L}\p{N}+$€£-]+|[^\p{L}\p{N}%]+$", "")
    return F.lower(F.when(kind.startswith("<num>"), number).otherwise(F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")))


def windows(form: int, step: int, n: int = WINDOW, run: int = RUN) -> Column:
    """(form, run, at, h) of the n-word windows of a form that start at every step-th word, if there are ``run`` words."""
    words = F.col(f"w{form}")
    starts = F.when(count_of(words) >= run, F.sequence(F.lit(0), F.size(words) - 2 - n, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(
        starts,
        lambda i: F.struct(F.lit(form).alias("form"), F.lit(run).alias("run"), i.alias("at"), F.xxhash64(F.slice(words, i + 2, F.lit(n))).alias("h")),
    )


def _item_windows(items: DataFrame, short: list[int]) -> DataFrame:
    """(h, run, form, item_id, q): slim rows of all items' windows; an item under RUN words is one window."""
    rows = None
    for form in (*FORMS, PLAIN):
        words = F.col(f"w{form}")
        own = windows(form, 1) if form != PLAIN else F.array().cast(_WINDOWS)
        for m in short:
            own = F.when(count_of(words) == m, windows(form, 1, m, m)).otherwise(own)
        w = items.select("item_id", words.alias("w"), F.explode(own).alias("x")).select("item_id", "w", "x.*")
        # a window that is mostly capitalised words would match any title or shouted text
        if form == CAPITALISED:
            literal = F.size(F.filter(F.slice("w", F.col("at") + 2, F.lit(WINDOW)), lambda x: x != "<name>"))
            w = w.where((F.col("run") < RUN) | (2 * literal >= WINDOW))
        literal = F.size(F.filter("w", lambda x: (x != "") & ~x.rlike("^<(num|unit|name)>")))
        w = w.where((F.col("run") == RUN) | (literal > 0 if form == PLAIN else 2 * literal >= F.col("run")))
        w = w.select("h", "run", "form", "item_id", F.col("at").alias("q"))
        rows = w if rows is None else rows.union(w)
    return rows


_WINDOWS = "array<struct<form:int,run:int,at:int,h:bigint>>"


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, n_slots) for each document that holds a run of RUN words of an item's template.

    An item under RUN words matches as a whole, at any word of a document: by its template if half of
    its words are no slots, else by its words. Null and empty texts match nothing. Slots of the runs of
    one alignment must map one to one between item and document, placeholders of items to values of
    documents; an alignment where one value stands for two is no match, unless VERBATIM words of it in
    one piece are the same words. Case and punctuation around a value don't count. A row that repeats a
    doc_id is judged by itself and its hits are the id's; a null doc_id is an id of its own; items that
    repeat an item_id are items of one name. Only the named columns are read; hits are aggregated by
    document, item and alignment.
    """
    b = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("_bt"))
    items = words_of(b, F.col("_bt"), True, "item_id")
    size = count_of(F.col("w0"))
    short = sorted(r[0] for r in items.where((size > 0) & (size < RUN)).select(size).distinct().collect())
    n = b.agg(F.sum(F.size(F.split(F.coalesce("_bt", F.lit("")), r"\s+")))).first()[0] or 0
    slim = _item_windows(items, short)
    d = docs.select(F.xxhash64(F.col(doc_id), F.col(text)).alias("rk"), F.col(doc_id).alias("doc_id"), F.col(text).alias("_dt"))
    every = [windows(f, STRIDE) for f in FORMS] + [windows(f, 1, m, m) for m in short for f in (*FORMS, PLAIN)]
    places = words_of(d, F.col("_dt"), bool(short), "rk").select("rk", F.explode(F.concat(*every)).alias("w"))
    places = places.select("rk", F.col("w.h").alias("h"), F.col("w.run").alias("run"), F.col("w.form").alias("form"), F.col("w.at").alias("p"))
    hits = places.join(F.broadcast(slim) if n <= BROADCAST_WORDS else slim, ["h", "run", "form"])
    lines = hits.select("rk", "item_id", "form", "run", (F.col("p") - F.col("q")).alias("shift")).distinct()
    # written, as the texts are fetched by it twice: only alignments that hit are in it
    return _judged(Scratch(docs.sparkSession, "decontamination").save(lines, "lines"), d, b)


def _judged(lines: DataFrame, d: DataFrame, b: DataFrame) -> DataFrame:
    """Compares the alignments (rk, item_id, form, run, shift) with the texts of both sides."""
    wanted = d.join(lines.select("rk").distinct(), "rk", "left_semi")
    of_doc = words_of(wanted.withColumn("r", F.split(spaced(F.col("_dt")), " ")), F.col("_dt"), True, "rk", "doc_id", "r")
    of_item = words_of(b.withColumn("br", F.split(spaced(F.col("_bt")), " ")), F.col("_bt"), True, "item_id", "br")
    of_item = of_item.select("item_id", "br", *[F.col(f"w{f}").alias(f"b{f}") for f in (*FORMS, PLAIN)])
    pick = lambda c: F.element_at(F.array(*[F.col(f"{c}{f}") for f in (*FORMS, PLAIN)]), F.col("form") + 1)
    rows = (
        lines.join(of_doc, "rk")
        .join(of_item, lines["item_id"].eqNullSafe(of_item["item_id"]))
        .select("doc_id", lines["item_id"], "rk", "form", "run", "shift", "r", "br", pick("w").alias("t"), pick("b").alias("bt"))
    )
    rows = rows.select(
        *[c for c in rows.columns if c not in ("t", "bt", "r", "br")],
        *[F.slice(c, F.lit(2), count_of(F.col(c))).alias(c) for c in ("t", "bt", "r", "br")],
    )
    # the words that lie on both sides; an item under RUN words has them all
    first = F.greatest(F.col("shift"), F.lit(0))
    size = F.greatest(F.least(F.size("t"), F.size("bt") + F.col("shift")) - first, F.lit(0))
    rows = rows.select("*", first.alias("first"), size.alias("size"))
    part = lambda c: F.slice(c, F.col("first") + 1, F.col("size"))
    own = lambda c: F.slice(c, F.col("first") - F.col("shift") + 1, F.col("size"))
    words = F.transform(
        F.arrays_zip(part("t").alias("t"), own("bt").alias("bt"), part("r").alias("r"), own("br").alias("br")),
        lambda x: F.struct(
            F.coalesce(x["t"] == x["bt"], F.lit(False)).alias("same"),
            x["t"].alias("kind"),
            value(x["bt"], x["br"]).alias("item_value"),
            value(x["t"], x["r"]).alias("doc_value"),
        ),
    )
    rows = rows.select("doc_id", "item_id", "rk", "form", "run", "shift", "size", once(words).alias("x"))
    true = lambda n: F.array_repeat(F.lit(True), n)
    starts = lambda flags, n: F.when(F.col("size") >= n, F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: F.slice(flags, i, n) == true(n))).otherwise(F.array().cast("array<boolean>"))
    rows = rows.select(
        "*",
        once(
            F.struct(
                F.col("x.same").alias("same"),
                F.transform("x", lambda x: F.coalesce(x["item_value"] == x["doc_value"], F.lit(False))).alias("equal"),
            )
        ).alias("y"),
    )
    rows = rows.select(
        "*",
        once(
            F.struct(
                starts(F.col("y.same"), F.col("run")).alias("runs"),
                F.array_contains(starts(F.col("y.equal"), F.lit(VERBATIM)), True).alias("verbatim"),
            )
        ).alias("z"),
    )
    rows = rows.where(F.array_contains("z.runs", True))
    # a word lies in a run if one of the last ``run`` places up to it starts one
    back = lambda i: F.greatest(i - F.col("run") + 2, F.lit(1))
    inside = lambda i: F.array_contains(F.slice("z.runs", back(i), i + 2 - back(i)), True)
    slots = F.filter("x", lambda x, i: x["kind"].rlike("^<(num|unit|name)>") & inside(i))
    slots = F.array_distinct(F.transform(slots, lambda x: F.struct(x["kind"], x["item_value"], x["doc_value"])))
    found = rows.select(
        "doc_id",
        "rk",
        "item_id",
        "form",
        "shift",
        slots.alias("slots"),
        F.col("z.verbatim").alias("verbatim"),
    ).groupBy("doc_id", "rk", "item_id", "shift")
    of = lambda *forms: F.array_distinct(F.flatten(F.collect_set(F.when(F.col("form").isin(*forms), F.col("slots")))))
    hit = lambda f: F.max(F.col("form") == f).alias(f"hit_{f}")
    # without names as slots, the names that the first form saw must still correspond
    seen = {MID: (MID,), NO_NAMES: (MID, NO_NAMES), CAPITALISED: (CAPITALISED,), PLAIN: (PLAIN,)}
    found = found.agg(*[hit(f) for f in seen], *[of(*g).alias(f"slots_{f}") for f, g in seen.items()], F.max("verbatim").alias("verbatim"))
    values = lambda slots, v: F.size(F.array_distinct(F.transform(slots, lambda x: F.struct(x["kind"], x[v]))))

    def count(form: int) -> Column:
        """Slots of the alignment in one form; null if it is no match there."""
        slots = F.col(f"slots_{form}")
        apart = (values(slots, "item_value") == F.size(slots)) & (values(slots, "doc_value") == F.size(slots))
        return F.when(F.col(f"hit_{form}") & (F.col("verbatim") | apart), F.size(slots))

    found = found.withColumn("n", F.greatest(*[count(f) for f in seen]))
    return found.where("n is not null").groupBy("doc_id", "item_id").agg(F.max("n").alias("n_slots"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item."""
    (name,) = unused(docs.columns, "hit")
    hit = contaminated(docs, benchmark).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit[name]), "left_anti")
