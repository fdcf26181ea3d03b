"""Lemmas by detachment: endings are taken off by rules, and what is left counts only if a lexicon has it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: English endings and what stands in their place, by part of speech, in order.
ENDINGS = {
    "n": [("s", ""), ("ses", "s"), ("ves", "f"), ("ves", "fe"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y")],
    "v": [("s", ""), ("ies", "y"), ("ied", "y"), ("es", "e"), ("es", ""), ("ed", "e"), ("ed", ""), ("ing", "e"), ("ing", "")],
}
#: Irregular forms (form, lemma, part of speech).
IRREGULAR = [
    ("analyses", "analysis", "n"), ("bases", "basis", "n"), ("children", "child", "n"), ("crises", "crisis", "n"), ("criteria", "criterion", "n"),
    ("feet", "foot", "n"), ("hypotheses", "hypothesis", "n"), ("indices", "index", "n"), ("men", "man", "n"), ("mice", "mouse", "n"), ("people", "person", "n"),
    ("phenomena", "phenomenon", "n"), ("theses", "thesis", "n"), ("women", "woman", "n"), ("became", "become", "v"), ("chosen", "choose", "v"),
    ("did", "do", "v"), ("found", "find", "v"), ("gave", "give", "v"), ("given", "give", "v"), ("had", "have", "v"), ("has", "have", "v"), ("held", "hold", "v"),
    ("led", "lead", "v"), ("made", "make", "v"), ("rose", "rise", "v"), ("sold", "sell", "v"), ("taken", "take", "v"), ("was", "be", "v"), ("went", "go", "v"), ("were", "be", "v"),
]


def candidates(form: Column, pos: str) -> Column:
    """(word, place) of all that the rules make of a form: itself, rules in order, then stems with a doubled consonant."""
    made = [F.struct(form.alias("word"), F.lit(0).alias("place"))]
    for i, (end, put) in enumerate(ENDINGS[pos], 1):
        stem = F.substring(form, F.lit(1), F.length(form) - len(end))
        fits = F.endswith(form, F.lit(end)) & (F.length(form) > len(end))
        made.append(F.when(fits, F.struct(F.concat(stem, F.lit(put)).alias("word"), F.lit(i).alias("place"))))
        if pos == "v" and not put and end in ("ed", "ing"):
            twice = fits & F.rlike(stem, F.lit(r"([b-df-hj-np-tv-z])\1$"))
            made.append(F.when(twice, F.struct(F.substring(stem, F.lit(1), F.length(stem) - 1).alias("word"), F.lit(100).alias("place"))))
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def lemmas(terms: DataFrame, lexicon: DataFrame, exceptions: DataFrame | None = None, order: tuple[str, ...] = ("n", "v")) -> DataFrame:
    """(term, lemma) of each distinct term: reduced as a noun, and the result as a verb (or by the parts of speech given).

    lexicon has (word, pos), exceptions (form, word, pos). An exception whose word the lexicon has comes first; else the
    shortest of the form itself and of what the rules make of it, if the lexicon has any, ties by the rules' order; a
    stem with its doubled consonant taken off comes last. A form without any stays. Each distinct term is joined once
    for each part of speech.
    """
    out = terms.select("term").where("term IS NOT NULL").distinct().withColumn("lemma", F.col("term"))
    for pos in order:
        known = lexicon.where(F.col("pos") == pos).select(F.col("word").alias("__w")).distinct()
        tried = out.select("term", "lemma", F.explode(candidates(F.col("lemma"), pos)).alias("c")).select("term", "lemma", F.col("c.word").alias("__w"), F.col("c.place").alias("place"))
        if exceptions is not None:
            odd = exceptions.where(F.col("pos") == pos).select(F.col("form").alias("lemma"), F.col("word").alias("__w"))
            tried = tried.unionByName(out.join(odd, "lemma").select("term", "lemma", "__w", F.lit(-1).alias("place")))
        rank = F.struct(F.when(F.col("place") < 0, 0).when(F.col("place") < 100, 1).otherwise(2).alias("turn"), F.length("__w").alias("size"), F.col("place"), F.col("__w").alias("word"))
        best = tried.join(known, "__w").groupBy("term").agg(F.min(rank).alias("best"))
        out = out.join(best, "term", "left").select("term", F.coalesce("best.word", "lemma").alias("lemma"))
    return out
