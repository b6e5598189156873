"""Personal data: fixed patterns, and information-theoretic sanitisation of the words around them.

Built-in column functions only. Base spans (e-mail, IP address, payment card, telephone) come from patterns.
The entities they find are protected: corpus co-occurrence tells how strongly a term gives one away. Of N documents, n_e
hold an entity, n_t a term and n_te both; the term discloses PMI = log2(N n_te / (n_t n_e)) of the entity's information
log2(N / n_e), a share of one at most. Counts are of documents, over their whole texts. A term must share documents with
the entity in ``SUPPORT`` or more different contexts (the ``REACH`` code points on either side of the entity's mention),
so that copies of one text never make a term telling. Wherever a term that discloses at least ``GENERALISE`` of some
entity stands, in any document, it is generalised; from ``REMOVE`` on it is removed. Words that touch a base span stay.

Null and empty texts have no spans. Rows alike in doc_id and text are one document and each get its result;
a null doc_id is like any other value. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.session import written
from verdigris.llm.common import document_key, hub_join, let, running, running_sums, texts_of

KINDS = ["email", "ip", "card", "phone"]
#: A match may begin where a run begins or the last match ended: other starts of a run fare no better than its
#: first. Possessive repeats keep the search linear and free of recursion in long texts.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A quick look tells most texts that cannot match.
HINTS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: Code points of context on either side, the least contexts of a term with an entity, the shares of an
#: entity's information from which a term is generalised or removed, and what a term is. Of the documents with a term
#: that discloses a share s, a part (n_e / N) ** (1 - s) holds the entity: with 8 documents of 50,000, 17 % at 0.8.
REACH, SUPPORT, GENERALISE, REMOVE = 60, 3, 0.8, 0.95
TERM = r"\p{L}[\p{L}\p{N}]{2,}+"
#: A term as it stands in a text, with the digits ahead of it.
WORD = r"(?<![\p{L}\p{N}])\p{N}*+" + TERM
#: Code points of the pieces in which long texts are cut up, and how many telling terms are sent to every task.
PIECE, FEW_TERMS = 256, 200_000
#: Up to so many telling terms of a document are searched for by one pattern, which passes over other words; where there are
#: more, every word is looked up among them. Both find the same.
FEW_MARKS = 1000
#: Pairs of an entity and a term that one task makes of a document.
PAIRS = 1_000_000

_SPAN = "array<struct<start:bigint,end:bigint,entity:string,context:bigint>>"


def located(text: Column, pattern: str | Column) -> Column:
    """Matches of a pattern, leftmost and apart: array of (start, end, value, left, right) in code points.

    left and right are the texts up to the matches before and after. Positions are sums of lengths.
    """
    def build(pieces: Column, matches: Column) -> Column:
        lengths = F.transform(pieces, lambda p, i: (F.length(p) + F.when(i > 0, F.length(F.get(matches, i - 1))).otherwise(0)).cast("bigint"))
        return let(
            running_sums(lengths),
            lambda ends: F.transform(
                matches,
                lambda m, i: F.struct(
                    F.get(ends, i + 1).alias("start"),
                    (F.get(ends, i + 1) + F.length(m)).alias("end"),
                    m.alias("value"),
                    F.get(pieces, i).alias("left"),
                    F.get(pieces, i + 1).alias("right"),
                ),
            ),
        )

    regex = F.lit(pattern) if isinstance(pattern, str) else pattern
    return let(F.split(text, regex, -1), lambda pieces: let(F.regexp_extract_all(text, regex, F.lit(0)), lambda matches: build(pieces, matches)))


def valid(kind: str) -> Callable[[Column], Column]:
    """The test that a match of a kind must pass."""
    if kind == "ip":
        part = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)"
        return lambda m: m["value"].rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        digits = lambda m: F.regexp_replace(m["value"], r"[\x20-]", "")
        return lambda m: F.length(digits(m)).between(16, 19) & F.call_function("luhn_check", digits(m))
    if kind == "phone":
        return lambda m: F.length(F.regexp_replace(m["value"], "[^0-9]", "")).between(8, 15)
    return lambda m: F.lit(True)


def base_spans(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, __key, for each kind an array of spans (start, end, entity, context), and the distinct terms of the text.

    An entity is a match in lower case after its kind; a context is a hash.
    """
    texts = texts_of(docs).select("doc_id", document_key().alias("__key"), "text")
    text = F.col("text")

    def span(kind: str) -> Callable[[Column], Column]:
        around = lambda m: F.xxhash64(F.lower(F.right(m["left"], F.lit(reach))), F.lit("|"), F.lower(F.left(m["right"], F.lit(reach))))
        return lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.concat(F.lit(kind + ":"), F.lower(m["value"])).alias("entity"), around(m).alias("context"))

    found = {}
    for kind in KINDS:
        matches = F.transform(F.filter(located(text, PATTERNS[kind]), valid(kind)), span(kind))
        hint = text.rlike("[0-9][ -]?[0-9]") if kind == "card" else text.contains(HINTS[kind])
        found[kind] = F.when(hint, matches).otherwise(F.array().cast(_SPAN))
    terms = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), 0))
    return texts.select("doc_id", "__key", *(e.alias(k) for k, e in found.items()), terms.alias("terms"))


def entity_documents(found: DataFrame, support: int) -> DataFrame:
    """(__key, entity, context, times, n_e) of entities with enough contexts: by document one context, its rows, and the entity's documents."""
    rows = found.select("__key", F.monotonically_increasing_id().alias("row"), F.explode(F.concat(*KINDS)).alias("m"))
    once = rows.groupBy("row", "__key", "m.entity").agg(F.min("m.context").alias("context"))
    mentions = written(once.groupBy("__key", "entity").agg(F.min("context").alias("context"), F.count(F.lit(1)).alias("times")))
    contexts = mentions.groupBy("entity", "context").agg(F.sum("times").alias("times"), F.count(F.lit(1)).alias("n"))
    entities = contexts.groupBy("entity").agg(F.sum("times").alias("n_e"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("contexts"))
    return hub_join(mentions, entities.where(F.col("contexts") >= support).drop("contexts"), "entity", mentions.count())


def grouped(rows: DataFrame, name: str) -> DataFrame:
    """(name, of, n): for each of ``rows`` (name, a, b) the least name with its digests a and b, and how many share them."""
    rows = written(rows)
    groups = written(rows.groupBy("a", "b").agg(F.min(name).alias("of"), F.count(F.lit(1)).alias("n")))
    found = hub_join(rows, groups.withColumn("size", F.col("n")), ["a", "b"], rows.count())
    return written(found.select(name, "of", F.col("size").alias("n")))


def _digests(*told: str) -> list[Column]:
    """Two digests, together 128 bits, of columns."""
    return [F.xxhash64(F.lit(k), *told) for k in (1, 2)]


def _of_all(digests: list[Column]) -> list[Column]:
    """Two digests of a set of rows that differ, from those of each."""
    return [F.bit_xor(d).alias(c) for c, d in zip("ab", digests)]


def entity_groups(near: DataFrame) -> DataFrame:
    """(entity, of, n): entities that stand in the same documents as often, their contexts dividing these alike, are one group.

    Whatever term is held against them, their shares are the same. Entities of a directory or signature are such groups.
    """
    contexts = near.groupBy("entity", "n_e", "context").agg(*_of_all(_digests("__key", "times")))
    entities = contexts.groupBy("entity", "n_e").agg(*_of_all(_digests("a", "b")))
    return grouped(entities.select("entity", *(d.alias(c) for c, d in zip("ab", _digests("n_e", "a", "b")))), "entity")


def term_groups(rare: DataFrame) -> DataFrame:
    """(term, of, n): terms of equally many documents, and of the same ones among those with entities, are one group."""
    terms = rare.groupBy("term", "n_t").agg(*_of_all(_digests("__key")))
    return grouped(terms.select("term", *(d.alias(c) for c, d in zip("ab", _digests("n_t", "a", "b")))), "term")


def firsts_of(rows: DataFrame, groups: DataFrame, name: str) -> DataFrame:
    """The rows of the one of each group that gives it its name."""
    sizes = rows.groupBy(name).agg(F.count(F.lit(1)).alias("n")).join(groups.where(F.col(name) == F.col("of")).select(name), name)
    return written(hub_join(rows, sizes, name, rows.count()))


def disclosing_groups(found: DataFrame, terms: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entity, term, share) between groups, from ``generalise`` on; then the groups of entities and those of terms.

    ``found`` is of ``base_spans``; ``terms`` has each term and n, its documents. A term in too many documents to disclose
    so much, whatever it shares with the entity, is left out before pairs are made. A document whose groups make more
    than ``PAIRS`` pairs is dealt out by entity, its terms being repeated for each piece.
    """
    near = written(entity_documents(found, support))
    documents, rows = found.count(), terms.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    held = found.join(near.select("__key").distinct(), "__key", "left_semi").select("__key", F.explode("terms").alias("term")).distinct()
    n = F.lit(float(documents))
    counted = hub_join(held, terms.withColumn("n_t", F.col("n")), "term", rows)
    largest = near.agg(F.coalesce(F.max("n_e"), F.lit(0))).first()[0]

    def may(n_e: Column) -> Column:
        return F.log2("n_t") <= F.log2(n) + generalise * F.log2(n_e / n) + 1e-9

    rare = written(counted.where((F.col("n_t") >= support) & may(F.lit(max(largest, 1)))))
    entity_of, term_of = entity_groups(near), term_groups(rare)
    near, rare = firsts_of(near, entity_of, "entity"), firsts_of(rare, term_of, "term")
    made = near.groupBy("__key").agg(F.count(F.lit(1)).alias("e")).join(rare.groupBy("__key").agg(F.count(F.lit(1)).alias("t")), "__key")
    heavy = made.select("__key", F.least("e", F.ceil(F.col("e") * F.col("t") / F.lit(PAIRS))).alias("pieces")).where("pieces > 1")
    pieces = F.coalesce("pieces", F.lit(1).cast("long"))
    dealt = near.join(heavy, "__key", "left").withColumn("piece", F.pmod(F.xxhash64("entity"), pieces)).drop("pieces")
    copies = rare.join(heavy, "__key", "left").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1))).drop("pieces")
    pairs = (
        copies.join(dealt, ["__key", "piece"])
        .where(may(F.col("n_e")))
        .groupBy("entity", "term", "n_t", "n_e", "context")
        .agg(F.sum("times").alias("times"))
        .groupBy("entity", "term", "n_t", "n_e")
        .agg(F.sum("times").alias("n_te"), F.count(F.lit(1)).alias("contexts"))
        .where(F.col("contexts") >= support)
    )
    share = F.log2(n * F.col("n_te") / (F.col("n_t") * F.col("n_e"))) / F.log2(n / F.col("n_e"))
    told = pairs.where(F.col("n_e") < documents).select("entity", "term", share.alias("share")).where(F.col("share") >= generalise)
    return told, entity_of, term_of


def disclosing_terms(found: DataFrame, terms: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """(entity, term, share) of every entity and term, from ``generalise`` on: as many rows as there are such pairs.

    ``sanitise`` does without them, as it needs the largest share of each term alone.
    """
    told, entity_of, term_of = disclosing_groups(found, terms, support, generalise)
    both = told.withColumnsRenamed({"entity": "of_entity", "term": "of_term"})
    both = both.join(entity_of.select("entity", F.col("of").alias("of_entity")), "of_entity")
    return both.join(term_of.select("term", F.col("of").alias("of_term")), "of_term").select("entity", "term", "share")


def telling_terms(found: DataFrame, terms: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """(term, share): the most that a term discloses of any entity, from ``generalise`` on."""
    told, _, term_of = disclosing_groups(found, terms, support, generalise)
    most = told.groupBy(F.col("term").alias("of")).agg(F.max("share").alias("share"))
    sizes = term_of.where("term = of").select("of", "n")
    return hub_join(term_of.select("term", "of"), most.join(sizes, "of"), "of", term_of.count()).select("term", "share")


def digest(spans: dict[str, str]) -> Column:
    """kind:start:end of arrays of spans, kinds in the given order, comma-joined."""

    def told(kind: str, column: str) -> Column:
        places = F.array_sort(F.transform(column, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))))
        return F.transform(places, lambda m: F.concat_ws(":", F.lit(kind), m["start"].cast("string"), m["end"].cast("string")))

    return F.array_join(F.concat(*(told(kind, column) for kind, column in spans.items())), ",")


def marks_of_documents(found: DataFrame, support: int, generalise: float, remove: float) -> DataFrame:
    """(__key, __marks): by document its telling terms, each with the mark that replaces it."""
    terms = written(found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")))
    telling = telling_terms(found, terms, support, generalise)
    marked = written(telling.select("term", F.when(F.col("share") >= remove, F.lit("")).otherwise(F.lit("[TERM]")).alias("mark")))
    rows = terms.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    held = found.select("__key", F.explode("terms").alias("term"))
    number, size = marked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("term")), F.lit(0))).first()
    if number <= FEW_TERMS and size <= 20 * FEW_TERMS:  # a few megabytes
        hits = held.join(F.broadcast(marked), "term")
    else:
        hits = hub_join(held, terms.join(marked, "term", "left"), "term", rows, by_place=True).where("mark is not null")
    return hits.groupBy("__key").agg(F.collect_set(F.struct("term", "mark")).alias("__marks"))


def sanitise(docs: DataFrame, reach: int = REACH, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """doc_id, n_<kind>, base_sha256, n_term, n_generalised, n_removed, spans and the sanitised text of every document.

    In the sanitised text base spans become [EMAIL], [IP], [CARD] or [PHONE], generalised terms [TERM], and
    removed terms nothing; overlapping base spans merge under the mark of the first.
    """
    found = written(base_spans(docs, reach))
    marks = marks_of_documents(found, support, generalise, remove)
    places = (F.transform(k, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))).alias(k) for k in KINDS)
    spans = found.select(F.col("__key").alias("__found"), *places).dropDuplicates(["__found"])
    spans = spans.join(marks.withColumnRenamed("__key", "__marked"), F.col("__found") == F.col("__marked"), "left").drop("__marked")
    texts = texts_of(docs).select("doc_id", document_key().alias("__key"), "text")
    rows = texts.join(spans, F.col("__key") == F.col("__found"))
    rows = rows.select("doc_id", *KINDS, rewritten().alias("new"))
    rows = rows.select("doc_id", *KINDS, F.col("new.terms").alias("term"), F.col("new.text").alias("text"))
    removed = F.size(F.filter("term", lambda t: t["mark"] == "")).cast("long")
    return rows.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(digest({k: k for k in KINDS}), 256).alias("base_sha256"),
        F.size("term").cast("long").alias("n_term"),
        (F.size("term").cast("long") - removed).alias("n_generalised"),
        removed.alias("n_removed"),
        digest({k: k for k in [*KINDS, "term"]}).alias("spans"),
        "text",
    )


def merged_spans() -> Column:
    """Base spans as (start, end, mark) by place, those that overlap joined under the mark of the first."""

    def marked(kind: str) -> Column:
        return F.transform(kind, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("mark")))

    def joined(spans: Column, ends: Column) -> Column:
        """``ends`` holds the furthest end of the spans before each place; a span that begins there or later is a first one."""
        at = F.filter(F.transform(spans, lambda m, i: F.when(m["start"] >= F.get(ends, i), i)), lambda i: i.isNotNull())
        furthest = lambda firsts, k: F.get(ends, F.coalesce(F.get(firsts, k + 1), F.size(spans)))
        one = lambda firsts, i, k: F.struct(F.get(spans, i)["start"].alias("start"), furthest(firsts, k).alias("end"), F.get(spans, i)["mark"].alias("mark"))
        return let(at, lambda firsts: F.transform(firsts, lambda i, k: one(firsts, i, k)))

    ends = lambda spans: running(F.transform(spans, lambda m: m["end"]), 0, lambda a, x: F.greatest(a, x))
    return let(F.array_sort(F.concat(*map(marked, KINDS))), lambda spans: let(ends(spans), lambda ends: joined(spans, ends)))


def mark_of(term: Column, marks: Column) -> Column:
    """The mark of a term in an array of (term, mark) sorted by term, null if it has none; a binary search."""
    halvings = F.when(F.size(marks) > 0, F.sequence(F.ceil(F.log2(F.size(marks) + 1)).cast("int") - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))

    def step(at: Column, k: Column) -> Column:
        ahead = at + F.call_function("shiftleft", F.lit(1), k)
        return F.when(F.get(marks, ahead - 1)["term"] <= term, ahead).otherwise(at)

    found = F.aggregate(halvings, F.lit(0), step)
    return let(F.get(marks, found - 1), lambda last: F.when(last["term"] == term, last["mark"]))


def rewritten() -> Column:
    """struct<terms: array<struct<start, end, mark>>, text>: where marked terms stand, and the text with all marks in place.

    The text is cut up at its base spans; what lies between is searched for terms and put together again, so the work
    is in proportion to the text and its spans.
    """
    text, size = F.col("text"), F.length("text").cast("bigint")
    none = F.array().cast("array<struct<start:bigint,end:bigint,mark:string>>")

    def part(pieces: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / PIECE).cast("int")
        few = F.array_join(F.slice(pieces, first + 1, F.floor((b - 1) / PIECE).cast("int") - first + 1), "")
        return F.when(b > a, F.substring(few, (a - first * PIECE + 1).cast("int"), (b - a).cast("int"))).otherwise("")

    def between(pieces: Column, spans: Column, marks: Column, pattern: Column) -> Column:
        """For the stretch before each span, and the last: its terms, its new text, and the mark that follows."""

        def stretch(a: Column, b: Column, mark: Column) -> Column:
            def replaced(m: Column) -> Column:
                """start and end of a match of the pattern, its digits ahead of the term, and the mark (null: stays)."""
                ahead = F.regexp_extract(m["value"], r"^\p{N}*+", 0)
                start = m["start"] + F.length(ahead)
                touches = ((start == 0) & (a > 0)) | ((m["end"] == b - a) & (b < size))
                term = F.lower(F.substr(m["value"], F.length(ahead) + 1))
                own = let(term, lambda term: mark_of(term, marks))
                return F.struct(m.alias("m"), (start + a).alias("start"), (m["end"] + a).alias("end"), ahead.alias("ahead"), F.when(~touches, own).alias("mark"))

            def built(gap: Column) -> Column:
                def joined(found: Column) -> Column:
                    replaced = F.filter(found, lambda m: m["mark"].isNotNull())
                    terms = F.transform(replaced, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["mark"].alias("mark")))
                    body = F.array_join(F.transform(found, lambda m: F.concat(m["m"]["left"], F.coalesce(F.concat(m["ahead"], m["mark"]), m["m"]["value"]))), "")
                    rest = F.when(F.size(found) == 0, gap).otherwise(F.get(found, F.size(found) - 1)["m"]["right"])
                    return F.struct(terms.alias("terms"), F.concat(body, rest, mark).alias("text"))

                return let(F.transform(located(gap, pattern), replaced), joined)

            plain = lambda gap: F.struct(none.alias("terms"), F.concat(gap, mark).alias("text"))
            return let(part(pieces, a, b), lambda gap: F.when(F.col("__marks").isNotNull(), built(gap)).otherwise(plain(gap)))

        def ends(i: Column) -> Column:
            before, after = F.get(spans, i - 1)["end"], F.get(spans, i)
            begin = F.when(i > 0, before).otherwise(F.lit(0).cast("bigint"))
            return stretch(begin, F.coalesce(after["start"], size), F.coalesce(after["mark"], F.lit("")))

        return F.transform(F.sequence(F.lit(0), F.size(spans)), ends)

    def whole(stretches: Column) -> Column:
        return F.struct(F.flatten(F.transform(stretches, lambda s: s["terms"])).alias("terms"), F.array_join(F.transform(stretches, lambda s: s["text"]), "").alias("text"))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), 0)
    few = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])\p{N}*+(?:"), F.array_join(F.col("__marks.term"), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    pattern = F.when(F.size("__marks") <= FEW_MARKS, few).otherwise(F.lit(WORD))
    searched = lambda pieces, spans: let(F.array_sort("__marks"), lambda marks: let(pattern, lambda pattern: let(between(pieces, spans, marks, pattern), whole)))
    new = let(pieces, lambda pieces: let(merged_spans(), lambda spans: searched(pieces, spans)))
    untouched = (F.col("__marks").isNull()) & (F.size(F.concat(*KINDS)) == 0)
    return F.when(untouched, F.struct(none.alias("terms"), text.alias("text"))).otherwise(new)
