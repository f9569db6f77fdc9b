"""Personal data and the terms that give it away, by corpus co-occurrence. DataFrame functions only.

Email addresses, IP addresses, card and phone numbers are found by patterns. They are the protected entities: for each term
of a document that holds an entity, the corpus says how much knowing the term tells about the entity. With N documents, n(e)
that hold the entity, n(t) that hold the term and n(t, e) that hold both, p(t) = n(t) / N, and the term discloses

    PMI / IC = log(p(t | e) / p(t)) / log(N / n(e)),   p(t | e) = (n(t, e) + PRIOR p(t)) / (n(e) + PRIOR)

of the entity's information. Any rare word of a document with an entity has a large share by chance alone, so a term must
also pass a test: the log-likelihood ratio G2 of its fourfold table has to reach 2 ln(pairs / ALPHA), which is more than the
chance of ``ALPHA`` to see one such pair among all that were tested. One document in common is never enough for that. Terms
above ``GENERALISE`` are replaced by a placeholder, those above ``REMOVE`` are taken out, wherever they stand in a document that
holds the entity.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table, unpacked, whole_row

LOCAL = "[A-Za-z0-9._%+-]"
#: The patterns of the base kinds. The look-behinds start a match where the leftmost one must start, so that a long run of
#: characters is tried once; possessive loops neither go back nor recurse.
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that a text with a match passes.
HINTS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
}
KINDS = tuple(PATTERNS)
#: Words of letters and digits, of any length; the statistics decide which of them matter.
TERM = r"[\p{L}\p{N}][\p{L}\p{M}\p{N}]*+"
PRIOR = 0.5
GENERALISE, REMOVE = 0.7, 0.9
ALPHA = 0.05
#: Code points of a block of text; places are looked up within blocks, so that long texts cost no square.
BLOCK = 1024
SPAN = "array<struct<start:bigint,end:bigint,value:string>>"


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(
            F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", "")),
            lambda p: (F.char_length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255),
        )
    if kind == "card":
        return F.char_length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.char_length(digits).between(9, 15)
    return F.lit(True)


def _hinted(text: Column) -> Column:
    return F.coalesce(HINTS["email"](text) | HINTS["ip"](text) | HINTS["card"](text) | HINTS["phone"](text), F.lit(False))


def _pieces(text: Column, pattern: str) -> Column:
    """Each leftmost, non-overlapping match with the text between it and the one before: (value, gap), in two linear passes."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.arrays_zip(found.alias("value"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("gap"))


def base_spans(texts: DataFrame) -> DataFrame:
    """``doc, kind, start, end, value`` of every valid match; ``texts`` has ``doc, text``, and rows that share a doc share a text.

    A match is a row, whose place is the running sum of the lengths before it, so a text of many matches costs no square.
    """
    text = F.col("text")
    none = F.array().cast("array<struct<value:string,gap:string>>")
    kinds = F.array(*(
        F.struct(F.lit(k).alias("kind"), F.when(HINTS[k](text), _pieces(text, p)).otherwise(none).alias("pieces")) for k, p in PATTERNS.items()
    ))
    rows = texts.select("doc", F.explode(kinds).alias("k")).select("doc", "k.kind", F.posexplode("k.pieces").alias("nth", "p"))
    rows = rows.select("doc", "kind", "nth", "p.value", F.char_length("p.gap").cast("long").alias("gap"), F.char_length("p.value").cast("long").alias("size"))
    rows = rows.dropDuplicates(["doc", "kind", "nth"])
    so_far = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("doc", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.select("doc", "kind", (so_far - F.col("size")).alias("start"), so_far.alias("end"), "value")
    test = F.lit(False)
    for kind in KINDS:
        test = F.when(F.col("kind") == kind, valid(kind, F.col("value"))).otherwise(test)
    return rows.where(test)


def _words_of(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def _classes(spans: DataFrame) -> DataFrame:
    """``doc, class, n_e``: the entities of each document. Entities that stand in the same documents have the same figures and are one class."""
    value = F.col("value")
    plain = F.when(F.col("kind") == "email", F.lower(value)).when(F.col("kind") == "ip", value).otherwise(F.regexp_replace(value, "[^0-9]", ""))
    owners = spans.select("doc", F.xxhash64("kind", plain).alias("entity")).distinct()
    same = owners.groupBy("entity").agg(F.count("*").alias("n_e"), F.bit_xor("doc").alias("x"), F.bit_xor(F.xxhash64("doc")).alias("y"))
    same = same.select("entity", "n_e", F.xxhash64("n_e", "x", "y").alias("class"))
    return owners.join(same, "entity").select("doc", "class", "n_e").distinct()


def likelihood_ratio(both: Column, one: Column, other: Column, n: Column) -> Column:
    """G2 of the fourfold table with margins ``one`` and ``other`` of ``n``, ``both`` in common; 0 where they shun each other."""
    cells = [(both, one * other), (one - both, one * (n - other)), (other - both, (n - one) * other), (n - one - other + both, (n - one) * (n - other))]
    parts = [F.when(seen > 0, seen * F.log(seen * n / expected)).otherwise(F.lit(0.0)) for seen, expected in cells]
    return F.when(both * n > one * other, 2 * (parts[0] + parts[1] + parts[2] + parts[3])).otherwise(F.lit(0.0))


def disclosing(docs: DataFrame, seen: DataFrame, scratch: Scratch, prior: float, generalise: float, alpha: float) -> DataFrame:
    """``class, term, share``: the pairs with evidence whose share of disclosed information reaches ``generalise``.

    ``seen``: doc, class, n_e, term. Pairs that could not pass the test whatever the frequency of their term are left out
    first. The terms of the corpus are counted in each task before they are shuffled, and joined with the wanted ones after.
    """
    pairs = scratch.write(seen.groupBy("class", "n_e", "term").agg(F.count("*").alias("n_te")))
    n, tested = docs.count(), pairs.count()
    needed = 2 * math.log(max(tested, 1) / alpha)
    total = F.lit(float(max(n, 1)))
    # of all tables with n_te in common, those where nothing else holds term or entity have the largest ratio
    pairs = pairs.where(likelihood_ratio(F.col("n_te"), F.col("n_te"), F.col("n_te"), total) >= needed)
    terms = scratch.write(pairs.select("term").distinct())
    counts = docs.where("text IS NOT NULL").select(F.explode(_words_of(docs["text"])).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    counts = scratch.write(counts.join(terms, "term"))
    joined = pairs.join(counts, "term").withColumn("n_t", F.greatest("n_t", "n_te"))
    p = F.col("n_t") / total
    given = (F.col("n_te") + prior * p) / (F.col("n_e") + prior)
    share = F.log(given / p) / F.log(total / F.col("n_e"))
    evidence = likelihood_ratio(F.col("n_te"), F.col("n_e"), F.col("n_t"), total)
    return joined.where(F.col("n_e") < total).where(evidence >= needed).select("class", "term", share.alias("share")).where(F.col("share") >= generalise)


def _places(texts: DataFrame, spans: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc, start, end, share``: where the wanted terms (doc, term, share) stand in the texts (doc, text), clear of the spans.

    Every word of these texts is a row; its place is the running sum of the lengths before it.
    """
    pieces = texts.select("doc", F.posexplode(_pieces(F.col("text"), TERM)).alias("nth", "p"))
    in_text = Window.partitionBy("doc").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.char_length("p.value").cast("long")
    words = pieces.select(
        "doc", F.lower("p.value").alias("term"), F.sum(F.char_length("p.gap").cast("long") + size).over(in_text).alias("end"), size.alias("size"),
    )
    words = words.join(wanted, ["doc", "term"]).select("doc", (F.col("end") - F.col("size")).alias("start"), "end", "share")
    near = spans.join(texts.select("doc"), "doc", "left_semi").select("doc", "start", "end", F.lit(None).cast("double").alias("share"))
    is_span = F.col("share").isNull()
    by_start = Window.partitionBy("doc").orderBy("start", F.col("share").isNotNull())
    before = F.max(F.when(is_span, F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    by_end = Window.partitionBy("doc").orderBy(F.desc("start"), F.col("share").isNull())
    after = F.min(F.when(is_span, F.col("start"))).over(by_end.rowsBetween(Window.unboundedPreceding, -1))
    both = words.unionByName(near).withColumn("before", before).withColumn("after", after)
    clear = F.coalesce(F.col("before") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("after") >= F.col("end"), F.lit(True))
    return both.where(~is_span & clear).select("doc", "start", "end", "share")


def _lists(rows: DataFrame, lists: dict[str, Column], item: Column) -> DataFrame:
    """Per document one sorted array for each condition."""
    return rows.groupBy("doc").agg(*(F.array_sort(F.collect_list(F.when(test, item))).alias(name) for name, test in lists.items()))


def private_spans(docs: DataFrame, prior: float = PRIOR, generalise: float = GENERALISE, remove: float = REMOVE, alpha: float = ALPHA) -> DataFrame:
    """``doc_id, th, email, ip, card, phone, generalised, removed`` for every row of ``docs`` (``doc_id``, ``text``).

    The first four are arrays of (start, end, value) by the patterns, the last two arrays of (start, end) of disclosing
    terms clear of these; offsets count code points, ends are exclusive; ``th`` is a hash of the text, by which rows that share a
    doc_id are told apart. A null text has no spans, nor has an empty one. Of a very long text each match and each word is a row
    while it is placed, and the work grows with its length alone. Null ids stay null, repeated rows are each answered (and
    count as one document in the statistics of their entities), other columns are ignored, an empty table gives no rows.
    Writes its intermediate tables to the shared folder and runs the jobs for that.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    th = F.xxhash64("text")
    keyed = docs.select("doc_id", th.alias("th"), F.xxhash64(F.col("doc_id").isNull(), "doc_id", th).alias("doc"), "text")
    hinted = scratch.write(keyed.where(_hinted(F.col("text"))).select("doc", "text"))
    spans = scratch.write(base_spans(hinted))
    classes = scratch.write(_classes(spans))
    held = hinted.join(classes.select("doc").distinct(), "doc", "left_semi")
    terms = held.select("doc", F.explode(_words_of(F.col("text"))).alias("term")).distinct()
    seen = scratch.write(terms.join(classes, "doc"))
    flagged = scratch.write(disclosing(docs, seen, scratch, prior, generalise, alpha))
    wanted = scratch.write(seen.join(flagged, ["class", "term"]).groupBy("doc", "term").agg(F.max("share").alias("share")))
    texts = scratch.write(hinted.join(wanted.select("doc").distinct(), "doc", "left_semi").dropDuplicates(["doc"]))
    place = F.struct("start", "end")
    base = _lists(spans, {k: F.col("kind") == k for k in KINDS}, F.struct("start", "end", "value"))
    more = _lists(_places(texts, spans, wanted), {"generalised": F.col("share") < remove, "removed": F.col("share") >= remove}, place)
    joined = keyed.select("doc_id", "th", "doc").join(base, "doc", "left").join(more, "doc", "left")
    empty = {k: F.array().cast(SPAN) for k in KINDS} | {k: F.array().cast("array<struct<start:bigint,end:bigint>>") for k in ("generalised", "removed")}
    return joined.select("doc_id", "th", *(F.coalesce(k, e).alias(k) for k, e in empty.items()))


def _between(blocks: Column, start: Column, end: Column) -> Column:
    """The text from ``start`` to ``end`` (code points) of a text cut into blocks."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
    at = lambda place: (place % BLOCK).cast("int")
    block = lambda i: F.coalesce(F.get(blocks, i), F.lit(""))
    one = F.substring(block(first), at(start) + 1, (end - start).cast("int"))
    several = F.concat(
        F.substring(block(first), at(start) + 1, F.lit(BLOCK)),
        F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(block(last), F.lit(1), at(end)),
    )
    return F.when(first == last, one).otherwise(several)


def sanitised(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the spans of its texts replaced: base kinds and generalised terms by their kind in brackets, removed terms by nothing.

    Overlapping spans are replaced together, up to the largest end, by the placeholder of the first of a base kind among them.
    All columns of ``docs`` are kept, whatever their names. The work for a text grows with its length and its spans.
    """
    kinds = {k: f"[{k.upper()}]" for k in KINDS} | {"generalised": "[TERM]", "removed": ""}

    def of(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.lit(kind not in KINDS).alias("term"), F.lit(kinds[kind]).alias("put")))

    spans = spans.select(F.xxhash64(F.col("doc_id").isNull(), "doc_id", "th").alias("doc"), "doc_id", "th", F.concat(*map(of, kinds)).alias("all"))
    spans = spans.where(F.size("all") > 0).dropDuplicates(["doc"])
    rows = spans.select("doc", "doc_id", "th", F.explode("all").alias("s")).select("doc", "doc_id", "th", "s.*")
    by_start = Window.partitionBy("doc").orderBy("start", "end", "term", "put")
    reach = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce(F.col("start") >= reach, F.lit(True)).cast("long")
    rows = rows.withColumn("apart", apart).withColumn("island", F.sum("apart").over(by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    islands = rows.groupBy("doc", "doc_id", "th", "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min(F.struct("term", "start", "end", "put")).alias("first")
    )
    before = F.lag("end", 1, 0).over(Window.partitionBy("doc").orderBy("island"))  # where the text before an island begins
    islands = islands.select("doc_id", "th", "start", "end", F.col("first.put").alias("put"), before.alias("from"))
    plan = islands.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("start", "end", "put", "from"))).alias("islands"))
    plan = plan.select(F.struct("doc_id", "th", "islands").alias("plan"))
    text = F.col("row").getField("text")
    rows = docs.select(whole_row(docs), docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("th"))
    joined = rows.join(plan, rows["doc_id"].eqNullSafe(F.col("plan.doc_id")) & rows["th"].eqNullSafe(F.col("plan.th")), "left")
    # explode keeps the blocks from being computed anew for every island
    cut = F.when(F.col("plan").isNotNull(), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))
    joined = joined.withColumn("blocks", F.explode(F.array(cut)))
    islands, none = F.col("plan.islands"), F.lit(0).cast("long")
    pieces = F.transform(islands, lambda s: F.concat(_between(F.col("blocks"), s["from"], s["start"]), s["put"]))
    tail = _between(F.col("blocks"), F.coalesce(F.element_at(islands, -1)["end"], none), F.char_length(text).cast("long"))
    clean = F.when(F.col("plan").isNull(), text).otherwise(F.concat(F.array_join(pieces, ""), tail))
    return unpacked(joined, docs.columns, text=clean)


def digests(spans: DataFrame) -> DataFrame:
    written = lambda k: F.transform(k, lambda s: F.concat_ws(":", F.lit(k), s["start"], s["end"]))
    base = F.concat(*(written(k) for k in KINDS))
    return spans.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(base, written("generalised"), written("removed")), ",").alias("spans"),
    )


def op7_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(private_spans(table(spark, sf_dir, "documents").select("doc_id", "text")))
