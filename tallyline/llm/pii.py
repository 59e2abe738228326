"""Personal data: base patterns, and information-theoretic sanitisation of the terms around them.

Base spans are e-mail addresses, IPv4 addresses, card and telephone numbers. Each distinct value is a protected entity.
Terms are words and numbers of any length in the documents of an entity. Over the corpus, a term's pointwise mutual
information with an entity, divided by the entity's information content, says which share of the entity's identity the
term discloses: nearly 1 if it occurs only with that entity. Terms beyond the lower threshold are generalised, those
beyond the upper one removed, wherever they occur in any document outside base spans.

All of it is DataFrame expressions. Positions come from splitting a text at a pattern: the pieces between matches and
the matches themselves, measured in code points, add up to the offsets. Arrays are built in short parts, since Spark
copies an array for each element that is appended; so a text with very many matches takes nearly linear time.

Defined cases: a null text counts as empty (its sanitised text stays null); empty texts and an empty table have no
spans. Statistics count rows, so a repeated row counts each time. An entity in every row has no information that could
be disclosed. A null doc_id is allowed. Terms are told apart by 64-bit hashes. Other columns are not read, and
sanitised() returns them as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm.common import checkpointed, join_counted, possibly_in, table

#: Rows by which each term is taken to occur independently of the entities, so that few rows tell a little less.
PRIOR_ROWS = 0.1
#: Disclosed shares from which a term is generalised, and removed.
GENERALISE, REMOVE = 0.8, 0.95
#: Elements that are appended to one array.
CHUNK = 64

KINDS = ("email", "ip", "card", "phone")
# Possessive quantifiers and look-behinds only spare the engine vain attempts inside a run; the matches are the same.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap conditions without which a kind cannot occur.
GUARDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
#: Stands for the characters of a base span; TERM also takes it, so that what touches a span is no term of its own.
SIGN = "\ue000"
TERM = rf"[{SIGN}\p{{L}}\p{{M}}\p{{N}}]+"

_BASE = "array<struct<start:int,rank:int,stop:int,kind:string,entity:string>>"
_TERMS = "array<struct<start:int,stop:int,share:double>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: higher-order functions would compute an expression for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _chunks(items: Column) -> Column:
    """An array in parts of CHUNK elements."""
    n = F.size(items)
    at = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda k: F.slice(items, k * CHUNK + 1, CHUNK))


def before(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of whole numbers, the combination of those before it, beginning with 0."""
    append = lambda acc, v: F.concat(acc, F.array(combine(F.element_at(acc, -1), v)))

    def of(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), combine))
        firsts = F.slice(F.aggregate(totals, F.array(F.lit(0)), append), 1, F.size(parts))
        return F.flatten(F.zip_with(parts, firsts, lambda p, first: F.slice(F.aggregate(p, F.array(first), append), 1, F.size(p))))

    return let(values, lambda v: let(_chunks(v), of))


def found(text: Column, pattern: str, value: Callable[[Column], Column] = lambda v: v) -> Column:
    """array<struct(start, stop, value)> of a pattern's matches, leftmost and not overlapping."""
    both = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("values"))
    item = lambda p, v: F.struct(F.length(p).alias("gap"), F.length(v).alias("size"), value(v).alias("value"))
    items = let(both, lambda x: F.zip_with(F.slice(x["pieces"], 1, F.size(x["values"])), x["values"], item))

    def span(s: Column, at: Column) -> Column:
        return F.struct((at + s["gap"]).alias("start"), (at + s["gap"] + s["size"]).alias("stop"), s["value"].alias("value"))

    return let(items, lambda i: F.zip_with(i, before(F.transform(i, lambda s: s["gap"] + s["size"]), lambda a, b: a + b), span))


def rebuilt(text: Column, cuts: Column, new: Callable[[Column, Column, Column], Column]) -> Column:
    """A text with its cuts, structs that have start and stop and are sorted by start, replaced.

    new(cut, at, own) is what stands for a cut when everything before the place `at` is written; own is the cut's text.
    """

    def part(text: Column, p: Column) -> Column:
        at = F.element_at(p, 1)["at"]
        end = F.array_max(F.transform(p, lambda i: F.greatest(i["at"] + i["gap"], i["cut"]["stop"])))
        return F.struct(p.alias("items"), at.alias("at"), F.substring(text, at + 1, end - at).alias("text"))

    def written(s: Column) -> Column:
        inside = lambda start, size: F.substring(s["text"], start - s["at"] + 1, size)

        def item(i: Column) -> Column:
            cut = i["cut"]
            return F.concat(inside(i["at"], i["gap"]), new(cut, i["at"], inside(cut["start"], cut["stop"] - cut["start"])))

        return F.array_join(F.transform(s["items"], item), "")

    def whole(text: Column, c: Column) -> Column:
        stops = F.transform(c, lambda x: x["stop"])
        item = lambda x, at: F.struct(at.alias("at"), F.greatest(F.lit(0), x["start"] - at).alias("gap"), x.alias("cut"))
        parts = let(F.zip_with(c, before(stops, lambda a, b: F.greatest(a, b)), item), lambda items: F.transform(_chunks(items), lambda p: part(text, p)))
        return F.concat(F.array_join(F.transform(parts, written), ""), F.substring(text, F.array_max(stops) + 1, F.length(text)))

    return F.when(F.size(cuts) > 0, let(text, lambda t: let(cuts, lambda c: whole(t, c)))).otherwise(text)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    turned = F.reverse(number)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False)))
    if kind == "card":
        return F.length(digits(value)).between(14, 19) & luhn(digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(10, 15)
    return F.lit(True)


def _entity(kind: str, value: Column) -> Column:
    same = F.lower(value) if kind == "email" else value if kind == "ip" else digits(value)
    return F.concat(F.lit(f"{kind}:"), same)


def base_spans(text: Column) -> Column:
    """array<struct(start, rank, stop, kind, entity)> by start, then kind; rank is the kind's place in the list."""
    return F.array_sort(F.concat(*(_spans_of(text, rank, kind) for rank, kind in enumerate(KINDS))))


def _spans_of(text: Column, rank: int, kind: str) -> Column:
    valid = F.filter(found(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"]))
    spans = F.transform(valid, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["stop"].alias("stop"), F.lit(kind).alias("kind"), _entity(kind, s["value"]).alias("entity")))
    return F.when(text.rlike(GUARDS[kind]), spans).otherwise(F.array().cast(_BASE))


def masked(text: Column, base: Column) -> Column:
    """The text with SIGN for each character of a base span, and a space for what SIGN it has itself."""
    return rebuilt(_unmasked(text), base, lambda c, at, own: F.repeat(F.lit(SIGN), F.greatest(F.lit(0), c["stop"] - F.greatest(c["start"], at))))


def _term(word: Column) -> Column:
    return F.xxhash64(F.lower(word))


def words(text: Column) -> Column:
    """The hashes of the different terms of a masked text."""
    return F.array_distinct(F.transform(F.filter(F.regexp_extract_all(text, F.lit(TERM), 0), lambda w: ~F.contains(w, F.lit(SIGN))), _term))


def _unmasked(text: Column) -> Column:
    return F.translate(text, SIGN, " ")


def disclosing_terms(rows: DataFrame, counts: DataFrame, n: int) -> DataFrame:
    """term and share, the greatest that it discloses of any entity; rows are those with base spans.

    Entities that occur in the same rows stand as one, so a text with thousands of them gives each of its terms once.
    """
    held = rows.select("row", F.explode(F.array_distinct(F.transform("base", lambda s: s["entity"]))).alias("entity"))
    entities = held.groupBy("entity").agg(F.count("*").alias("n_entity"), F.sum(F.xxhash64("row").cast("decimal(20,0)")).alias("mark"))
    entities = checkpointed(entities.select("entity", F.struct(F.xxhash64("mark").alias("alike"), "n_entity").alias("e")))
    alike = checkpointed(join_counted(held, entities, ["entity"], "inner").groupBy("row").agg(F.collect_set("e").alias("es")))
    n_alike, most_rows = alike.agg(F.coalesce(F.sum(F.size("es")), F.lit(0)), F.max(F.array_max(F.transform("es", lambda e: e["n_entity"])))).first()

    # n_pair <= n_entity, so a term in more rows than this cannot reach the share
    most = lambda n_entity: 1.01 * F.pow(n_entity, F.lit(GENERALISE)) * float(n) ** (1 - GENERALISE) + 1
    rare = counts.where(F.col("n_term") <= most(F.lit(float(most_rows or 1))))
    pairs = rows.select("row", F.explode("beside").alias("term")).join(rare, "term")
    pairs = join_counted(pairs, alike, ["row"], "inner", n_alike).select("term", "n_term", F.explode("es").alias("e")).where(F.col("n_term") <= most(F.col("e.n_entity")))
    pairs = pairs.groupBy("term", "n_term", F.col("e.alike").alias("alike"), F.col("e.n_entity").alias("n_entity")).agg(F.count("*").alias("n_pair"))
    usual = F.col("n_entity") / n
    known = (F.col("n_pair") + PRIOR_ROWS * usual) / (F.col("n_term") + PRIOR_ROWS)
    share = F.log2(known / usual) / F.nullif(-F.log2(usual), F.lit(0.0))
    return pairs.withColumn("share", share).where(F.col("share") >= GENERALISE).groupBy("term").agg(F.max("share").alias("share"))


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, text_key, base (spans with their entities), terms (spans with the disclosed share).

    One scan makes a compact row of base spans and, where there are any, of the terms beside them; a second counts the
    rows of every term; a third gives the places of the terms that disclose something. Texts are never shuffled: terms
    are, as hashes, and in the third scan only those that pass a table of bits of the disclosing ones, and so hardly
    any others.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", F.xxhash64(text).alias("text_key"), text.alias("text"))
    spans = keyed.withColumn("base", base_spans(F.col("text")))
    beside = F.when(F.size("base") > 0, words(masked(F.col("text"), F.col("base"))))
    rows = checkpointed(spans.select("doc_id", "text_key", "base", beside.alias("beside")))
    counts = checkpointed(keyed.select(F.explode(words(_unmasked(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term")))
    with_base = rows.where("beside IS NOT NULL").withColumn("row", F.monotonically_increasing_id())
    terms = checkpointed(disclosing_terms(with_base, counts, rows.count()))

    tokens = spans.select("text_key", F.explode(found(masked(F.col("text"), F.col("base")), TERM, lambda v: F.when(~F.contains(v, F.lit(SIGN)), _term(v)))).alias("t"))
    tokens = possibly_in(tokens.select("text_key", "t.start", "t.stop", F.col("t.value").alias("term")), "term", terms)
    span = F.struct("start", "stop", "share")
    places = checkpointed(tokens.join(terms.hint("merge"), "term").groupBy(F.col("text_key").alias("place_key")).agg(F.array_sort(F.collect_set(span)).alias("terms")))
    n_places = places.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    out = join_counted(rows, places, F.col("text_key") == F.col("place_key"), "left", n_places)
    return out.select("doc_id", "text_key", "base", F.coalesce("terms", F.array().cast(_TERMS)).alias("terms"))


def sanitised(docs: DataFrame) -> DataFrame:
    """docs with the sanitised text; all other columns remain.

    Base spans become [EMAIL] and so on; terms become [TERM], or only their first three letters stay. The spans of
    equal texts are equal, so they are joined to the texts by the texts' hashes.
    """
    spans = find_pii(docs).where((F.size("base") > 0) | (F.size("terms") > 0)).groupBy(F.col("text_key").alias("span_key")).agg(F.first(F.struct("base", "terms")).alias("found"))
    spans = checkpointed(spans)
    n_spans = spans.agg(F.coalesce(F.sum(F.size("found.base") + F.size("found.terms")), F.lit(0))).first()[0]
    packed = docs.select(F.struct(*(F.col(f"`{k}`") for k in docs.columns)).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    rows = join_counted(packed, spans, F.xxhash64(packed["text"]) == spans["span_key"], "left", n_spans)

    cut = lambda s, label: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), label.alias("label"))
    base = F.transform("found.base", lambda s: cut(s, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
    terms = F.transform("found.terms", lambda s: cut(s, F.when(s["share"] >= REMOVE, F.lit("[TERM]"))))

    def new(c: Column, at: Column, own: Column) -> Column:
        """Of overlapping base spans the first is replaced, and the rest of a later one goes too."""
        return F.when(c["start"] < at, F.lit("")).otherwise(F.coalesce(c["label"], F.concat(F.substring(own, 1, 3), F.lit("…"))))

    clean = F.when(F.col("found").isNull(), F.col("row.text")).otherwise(rebuilt(F.col("text"), F.array_sort(F.concat(base, terms)), new))
    return rows.select(*(clean.alias(k) if k == "text" else F.col(f"row.`{k}`") for k in docs.columns))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside base spans, spans of the kinds generalise and remove: terms and what sanitised() does with them."""
    rows = find_pii(table(spark, sf_dir, "documents"))
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    kind = lambda s: F.when(s["share"] >= REMOVE, F.lit("remove")).otherwise(F.lit("generalise"))
    terms = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), s["stop"].alias("stop"), kind(s).alias("kind")))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *(count(k) for k in KINDS), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.array_sort(F.concat(plain, terms))).alias("spans"), F.size("terms").cast("long").alias("n_terms"))


QUERIES = {"op5_pii": op5_pii}
ORACLE_SQL: dict[str, str] = {}
