"""Feature vectors of the two combining classifiers, at full width, as arrays of doubles that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contentlens.functions.texts import let, split_words

# The layers, the evidence that the vector takes from each with what stands for missing evidence, and the detectors.
LAYERS = ["perplexity", "stylometry", "transformer", "adversarial"]
PERPLEXITY = {"mean_perplexity": 80.0, "std_perplexity": 30.0, "burstiness": 30.0, "low_ppl_fraction": 0.3}
STYLOMETRY = {"ai_hedge_rate": 0.01, "human_casual_rate": 0.01, "type_token_ratio": 0.60, "em_dash_rate": 0.0, "comma_rate": 0.05, "sent_initial_diversity": 0.7}
SENTENCE_SPREAD, UNKNOWN = 5.0, 0.5
DETECTORS = ["text", "image", "video", "audio", "code"]


def _mean(values: Column) -> Column:
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))


def _spread(values: Column) -> Column:
    """Population deviation; null for none."""
    return let(_mean(values), lambda m: F.sqrt(_mean(F.transform(values, lambda x: (x - m) * (x - m)))))


def layer_vector(scores: dict[str, Column], evidence: dict[str, Column], text: Column) -> Column:
    """26 doubles: scores, which layers ran, their evidence, counts of the text, and the spread of the scores.

    A layer that did not run has a null score or none in ``scores``: .5 stands for its score
    and its evidence counts as missing, but for sent_len_mean and sent_len_std.  Null evidence and evidence that is not given take their defaults; doc_score_l3 and
    doc_score_l4 have .5.  Sentences end at full stops and have four words or more; a text has at least one.  A null text is an empty one.
    """
    none = F.lit(None).cast("double")
    got = {k: scores.get(k, none).cast("double") for k in LAYERS}
    said = lambda k, default: F.coalesce(evidence.get(k, none).cast("double"), default)
    of = lambda layer, k, default: F.when(got[layer].isNotNull(), said(k, F.lit(default))).otherwise(default)
    text = F.coalesce(text, F.lit(""))
    n_words = F.size(split_words(text)).cast("double")
    n_sentences = F.greatest(F.size(F.filter(F.split(text, r"\."), lambda s: F.size(split_words(s)) >= 4)), F.lit(1)).cast("double")
    ran = F.filter(F.array(*got.values()), lambda x: x.isNotNull())

    def vector(counts: Column) -> Column:
        average = counts["words"] / counts["sentences"]
        return F.array(
            *[F.coalesce(s, F.lit(UNKNOWN)) for s in got.values()], *[s.isNotNull().cast("double") for s in got.values()], *[of("perplexity", k, d) for k, d in PERPLEXITY.items()],
            said("sent_len_mean", average), said("sent_len_std", F.lit(SENTENCE_SPREAD)), *[of("stylometry", k, d) for k, d in STYLOMETRY.items()],
            of("transformer", "doc_score_l3", UNKNOWN), of("adversarial", "doc_score_l4", UNKNOWN), counts["words"], counts["sentences"], average, F.coalesce(_spread(ran), F.lit(0.0)),
        )

    return let(F.struct(n_words.alias("words"), n_sentences.alias("sentences")), vector)


def detector_vector(outputs: Column, watermark: Column, image_signal: Column, verified: Column) -> Column:
    """29 doubles from an array of structs type, score, confidence, error (boolean) and flagged (array of scores), and three signs.

    The last output of a type counts, the first one names the content; text stands for none and for types
    that are not known.  A failed detector has score .5, confidence 0 and no part in the mean, high, low and spread, where one
    that is absent counts with .5.  Segments of all outputs are counted.  Null arrays are empty, null errors and signs are false, null scores are .5 and null confidences 0.
    """
    def of_type(k: str):
        return lambda o: o["type"] == k

    def vector(out: Column) -> Column:
        last = {k: F.try_element_at(F.filter(out, of_type(k)), F.lit(-1)) for k in DETECTORS}
        failed = {k: F.coalesce(o["error"], F.lit(False)) for k, o in last.items()}
        scores = [F.when(failed[k], UNKNOWN).otherwise(F.coalesce(o["score"].cast("double"), F.lit(UNKNOWN))) for k, o in last.items()]
        sure = [F.when(failed[k], 0.0).otherwise(F.coalesce(o["confidence"].cast("double"), F.lit(0.0))) for k, o in last.items()]
        worked = F.filter(F.array(*[F.when(~failed[k], s) for k, s in zip(DETECTORS, scores)]), lambda x: x.isNotNull())
        kind = F.try_element_at(out, F.lit(1))["type"]
        is_text = ~F.coalesce(kind.isin(DETECTORS[1:]), F.lit(False))
        flagged = F.flatten(F.transform(out, lambda o: F.coalesce(o["flagged"].cast("array<double>"), F.array().cast("array<double>"))))
        sums = [F.coalesce(f(worked), F.lit(d)) for f, d in ((_mean, UNKNOWN), (F.array_max, UNKNOWN), (F.array_min, UNKNOWN), (_spread, 0.0))]
        signs = [F.coalesce(c, F.lit(False)).cast("double") for c in (watermark, image_signal, verified)]
        kinds = [is_text.cast("double"), *[F.coalesce(kind == k, F.lit(False)).cast("double") for k in DETECTORS[1:]]]
        return F.array(*scores, *sure, *[failed[k].cast("double") for k in DETECTORS], *sums, *signs, *kinds, F.size(flagged).cast("double"), F.coalesce(F.array_max(flagged), F.lit(0.0)))

    return let(F.coalesce(outputs, F.array()), vector)
