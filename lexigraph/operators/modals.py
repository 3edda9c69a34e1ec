"""Modal verbs in a table of tagged tokens (id, i, text, lemma, tag, pos, dep, head, ent_type); native windows and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab


def modals(tokens: DataFrame, key: str = "id") -> DataFrame:
    """Rows (key, i, text, lemma, negated, ought_to, reason) of all candidates: modal tags with a modal's lemma.

    reason is null for a modal; otherwise it says what speaks against it: a named entity, the part of a noun, or a 'd that stands for had.
    """
    low = F.lower("text")
    aside = F.col("pos").isin("ADV", "PART")
    after = Window.partitionBy(key).orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy(key).orderBy("i")
    seen = tokens.withColumns({
        # The next word that isn't an adverb or particle, and a "better" before it.
        "_next": F.min(F.when(~aside, F.struct("i", "tag"))).over(after),
        "_better": F.min(F.when(aside & (low == "better"), F.col("i"))).over(after),
        "_w1": F.lead(low, 1).over(order), "_w2": F.lead(low, 2).over(order), "_pos1": F.lead("pos", 1).over(order),
    })
    found = seen.where((F.col("tag") == "MD") & F.lower("lemma").isin(vocab.MODAL_LEMMAS)).withColumn("lemma", F.lower("lemma"))
    negated_heads = tokens.where("dep = 'neg'").select(key, F.col("head").alias("i"), F.lit(True).alias("_neg")).distinct()
    found = found.join(negated_heads, [key, "i"], "left")
    better = F.col("_better").isNotNull() & (F.col("_next").isNull() | (F.col("_better") < F.col("_next.i")))
    past = F.coalesce(F.col("_next.tag").isin("VBN", "VBD"), F.lit(False))
    had = (F.col("lemma") == "would") & (F.regexp_replace(F.lower("text"), "^'+", "") == "d") & (better | past)
    not_words = lambda c: F.coalesce(F.col(c).isin("n't", "not", "never"), F.lit(False))
    negated = (F.lower("text") == "cannot") | F.coalesce("_neg", F.lit(False)) | not_words("_w1") | (F.coalesce(F.col("_pos1").isin("PART", "ADV"), F.lit(False)) & not_words("_w2"))
    reason = (
        F.when(F.col("ent_type").isin("PERSON", "DATE", "TIME"), F.concat(F.lit("NER="), "ent_type"))
        .when(F.col("dep").isin(vocab.NOMINAL_DEPENDENCIES), F.concat(F.lit("dep="), "dep", F.lit(" (noun homograph)"))).when(had, "'d+VBN/better -> had (excluded)")
    )
    ought = (F.col("lemma") == "ought") & F.coalesce(F.col("_w1") == "to", F.lit(False))
    return found.select(key, "i", "text", F.when(reason.startswith("'d"), "had?").otherwise(F.col("lemma")).alias("lemma"), negated.alias("negated"), ought.alias("ought_to"), reason.alias("reason"))
