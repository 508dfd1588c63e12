"""Document fingerprints by SpotSigs: chains of content words that follow common words.

Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import number_within, row_key, staged
from .decontamination import SEPARATORS

# Common words of the languages met most often. Their places do not depend on what a text is about.
ANCHORS = tuple(
    (
        "the of and to in a is that for it was on are as with he be at by this from or an but not "
        "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es "
        "le la les et des en un une que est pour qui dans par sur plus ne se pas au du "
        "el los las y del una por con para su al lo como más o pero sus"
    ).split()
)
# One word in so many, by its hash, is an anchor as well: languages that the list does not know, code and tables have some, too.
ANCHOR_CLASSES = 16
# In a text with fewer than one anchor in so many words every word is an anchor, and content.
SPARSE = 32
CHAIN_WORDS = 2
SPOT_DISTANCE = 1
SIMILARITY = 0.8


def signatures(
    text: Column, anchors: Sequence[str] = ANCHORS, chain: int = CHAIN_WORDS, distance: int = SPOT_DISTANCE
) -> Column:
    """The sorted set of a text's signatures, as 64-bit numbers.

    Every anchor, and the beginning of the text, gives one: the anchor and the ``chain`` content words that follow it,
    each ``distance`` content words after the one before. Anchors are common words and those whose hash falls in a fixed class;
    all other words are content. Chains at the end of a text are shorter. The content words after the n-th anchor, at word p,
    begin with content word p - n; so words, anchors and content words are listed once and a text takes time in proportion
    to its length. Where anchors are so few that chains would leave out most of the text (:data:`SPARSE`), a chain begins at
    every word and goes on with the words after it. A text without words has no signature.
    """
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")
    common = list(dict.fromkeys(anchors))

    def is_anchor(word: Column) -> Column:
        return word.isin(common) | (F.pmod(F.xxhash64(word), F.lit(ANCHOR_CLASSES)) == 0)

    def chains(spoken: Column) -> Column:
        everywhere = F.sequence(F.lit(0), F.size(spoken) - 1)
        found = F.array(F.filter(everywhere, lambda at: is_anchor(F.get(spoken, at))))

        def with_places(places: Column) -> Column:
            sparse = F.size(places) * SPARSE < F.size(spoken)
            content = F.array(F.when(sparse, spoken).otherwise(F.filter(spoken, lambda word: ~is_anchor(word))))

            def with_content(kept: Column) -> Column:
                def signature(anchor: Column, first: Column) -> Column:
                    return F.xxhash64(anchor, *[F.get(kept, first + step * distance) for step in range(chain)])

                def at_place(at: Column, number: Column) -> Column:
                    return signature(F.get(spoken, at), F.when(sparse, at + 1).otherwise(at - number))

                begin = F.array(signature(F.lit(""), F.lit(0)))
                return F.concat(begin, F.transform(F.when(sparse, everywhere).otherwise(places), at_place))

            return F.get(F.transform(content, with_content), F.lit(0))

        return F.get(F.transform(found, with_places), F.lit(0))

    made = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, chains(w))), F.lit(0))
    return F.sort_array(F.array_distinct(F.coalesce(made, F.array().cast("array<bigint>"))))


def as_string(sigs: Column | str) -> Column:
    """A set of signatures as text: sixteen hexadecimal digits each."""
    column = F.col(sigs) if isinstance(sigs, str) else sigs
    digits = F.transform(column, lambda value: F.lpad(F.hex(value), 16, "0"))
    return F.lower(F.array_join(digits, ""))


def pruned_jaccard(a: Column, b: Column, floor: float = 0.0) -> Column:
    """Shared signatures over all signatures of two sets; two empty sets are alike.

    The ratio of the lengths bounds the result, so sets whose lengths are too far apart to reach ``floor`` get 0 without
    being compared.
    """
    bound = F.least(F.size(a), F.size(b)) / F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b))
    likeness = shared / (F.size(a) + F.size(b) - shared)
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
        .when((F.size(a) == 0) | (F.size(b) == 0) | (bound < floor), F.lit(0.0))
        .otherwise(likeness)
    )


def neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, doc_id, next_key, taken)``: for every different row the next by descending id, the first after the last.

    ``taken`` is a third of its characters. Rows that agree in id and text are one row here; a NULL id is the smallest,
    and rows of one id are ordered by the key made from their text.
    """
    rows = docs.select(
        F.lit(0).alias("all"),
        row_key(doc_id, F.col(text)).alias("key"),
        F.col(doc_id).alias("doc_id"),
        F.length(F.coalesce(F.col(text), F.lit(""))).alias("n"),
    ).dropDuplicates(["key"])
    ranked = staged(number_within(staged(rows, "ids"), "all", [F.col("doc_id").desc_nulls_last(), "key"], "at"), "ranked")
    last = ranked.count()
    following = ranked.select(F.col("key").alias("next_key"), F.pmod(F.col("at") - 1, F.lit(max(last, 1))).alias("at"))
    return ranked.join(following, "at").select("key", "doc_id", "next_key", F.floor(F.col("n") / 3).cast("int").alias("taken"))


def fingerprint_edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Fingerprints of every text and of the text whose last third is replaced by the beginning of the next one's.

    ``(doc_id, n_chars, edited, sigs, edited_sigs, next_sigs)``, one row per row of ``docs``. Texts are dealt once, by
    key; of the next text only the part that is needed and its signatures go to its neighbour. NULL is an empty text.
    Repeated rows get equal results, an empty table an empty one.
    """
    pairs = staged(neighbours(docs, doc_id, text), "pairs")
    whole = docs.select(
        row_key(doc_id, F.col(text)).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    repeated = docs.count() > pairs.count()
    source = whole.dropDuplicates(["key"]) if repeated else whole
    pieces = source.join(pairs.withColumnRenamed("key", "owner"), F.col("key") == F.col("next_key")).select(
        F.col("owner"),
        "doc_id",
        "taken",
        F.substring("text", F.lit(1), F.col("taken")).alias("piece"),
        signatures(F.col("text"), **options).alias("next_sigs"),
    )
    own = F.expr("substring(text, 1, n_chars - taken)")
    return (
        whole.join(pieces, F.col("key") == F.col("owner"))
        .withColumn("n_chars", F.length("text").cast("bigint"))
        .withColumn("edited", F.concat(own, "piece"))
        .select(
            "doc_id",
            "n_chars",
            "edited",
            signatures(F.col("text"), **options).alias("sigs"),
            signatures(F.col("edited"), **options).alias("edited_sigs"),
            "next_sigs",
        )
    )


def near_duplicate_pairs(
    docs: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text", **options
) -> tuple[DataFrame, DataFrame]:
    """All pairs of different fingerprints at least that alike, and who has which fingerprint.

    ``(a, b, likeness)`` with a < b, and ``(doc_id, class)``. Copies are one class and are not expanded. Sets are
    partitioned by length, so that a set can be as like only to sets of its own partition and the next ones to both sides;
    there they meet through their rarest signatures, as many as cannot all be missing from a partner, and are then
    compared. Sets without a signature are like no other.
    """
    marked = docs.select(F.col(doc_id).alias("doc_id"), signatures(F.col(text), **options).alias("sigs"))
    marked = staged(marked.withColumn("class", F.sha2(as_string("sigs"), 256)), "marked")
    sets = staged(marked.filter(F.size("sigs") > 0).select("class", "sigs").dropDuplicates(["class"]), "sets")
    single = sets.select("class", F.explode("sigs").alias("sig"))
    counts = single.groupBy("sig").agg(F.count("*").alias("times"))
    ordered = (
        single.join(counts, "sig")
        .groupBy("class")
        .agg(F.array_sort(F.collect_list(F.struct("times", "sig"))).alias("by_rarity"))
        .withColumn("len", F.size("by_rarity"))
    )
    prefix = F.slice("by_rarity", F.lit(1), F.col("len") - F.ceil(F.col("len") * similarity - 1e-9).cast("int") + 1)
    # The same length gives the same partition; lengths whose ratio is the similarity are one partition apart at most.
    place = F.floor(F.log("len") / F.log(F.lit(1 / similarity)) + 1e-9)
    probes = ordered.select("class", "len", place.alias("place"), F.explode(prefix).alias("p")).select(
        "class", "len", "place", F.col("p.sig").alias("sig")
    )
    left = probes.select(
        F.col("class").alias("a"), F.col("len").alias("a_len"), "sig", F.explode(F.array(F.col("place"), F.col("place") + 1)).alias("place")
    )
    right = probes.select(F.col("class").alias("b"), F.col("len").alias("b_len"), "sig", "place")
    bound = F.least("a_len", "b_len") >= F.lit(similarity) * F.greatest("a_len", "b_len") - 1e-9
    candidates = (
        left.join(right, ["sig", "place"])
        .filter((F.col("a") != F.col("b")) & bound)
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    pairs = (
        candidates.join(sets.select(F.col("class").alias("a"), F.col("sigs").alias("a_sigs")), "a")
        .join(sets.select(F.col("class").alias("b"), F.col("sigs").alias("b_sigs")), "b")
        .select("a", "b", pruned_jaccard(F.col("a_sigs"), F.col("b_sigs"), similarity).alias("likeness"))
        .filter(F.col("likeness") >= similarity)
    )
    return pairs, marked.select("doc_id", "class")
