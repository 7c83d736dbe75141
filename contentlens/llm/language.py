"""Language identification by mixture inference.

Each word of a text is drawn from one of several languages, whose likelihood of
a word is that of its character trigrams.  Expectation-maximisation estimates
the languages' proportions in a document; the set of languages is chosen by
penalised likelihood: the least is dropped as long as the fit loses less than
the penalty of a parameter.  The prediction is the language with the largest
proportion, and the proportion its score.

The trigram tables are fitted on a bounded sample of rows for each language
(``per_language``), by hash of the id and text; every language with a drawn row is
learned (beyond ``LANGUAGES`` of them there is an error, never a silent choice).  Scoring covers every whole text, with
arrays over many documents at once; a long text is read in parts.

Defined cases: a text that is null or has no letter is ``und`` with score 0;
with nothing learned, all are ``und``; ties go to the language first by name;
a run of letters longer than PART + 1,000 counts as several words; rows with a null lang are scored but not learned from; extra columns pass
through (lang_pred and lang_score are replaced).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentlens.llm.common import free, held_out

BUCKETS = 1 << 15
PER_LANGUAGE = 300
#: Languages at most: beyond, an error, as the table of BUCKETS x languages (at most 134 MB) goes to every worker.  Values (word x language) worked on at once, about.
LANGUAGES, VALUES = 1024, 1 << 24
#: Rounds of EM for each set of languages, penalty of one more language (times log of the words), characters read at once.
ROUNDS, PENALTY, PART = 8, 1.0, 1 << 20
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000))
    return _letters[0]


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Trigram bucket at each letter, and where words start among the letters."""
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    letter = _is_letter()[code]
    code = np.where(letter, code, 0).astype(np.uint64)
    at = np.flatnonzero(letter)
    mixed = code[at - 1] * np.uint64(0x9E3779B97F4A7C15) + code[at] * np.uint64(0xC2B2AE3D27D4EB4F) + code[at + 1] * np.uint64(0x165667B19E3779F9)
    return ((mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(49)).astype(np.int64), np.flatnonzero(~letter[at - 1])


def fit(documents: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Names and log-probabilities (bucket, language), from about per_language rows of each language outside the held-out fold."""
    known = documents.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    names = sorted(r["lang"] for r in counts.select("lang").limit(LANGUAGES + 1).collect())
    if len(names) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages to learn")
    if not names:
        return [], np.zeros((BUCKETS, 0), np.float32)
    drawn = F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(1_000_000)) / 1e6 < per_language / F.col("n")
    sample = known.join(F.broadcast(counts), "lang").where(drawn)  # broadcast: a row a language

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b["lang"], b["text"]):
                for i in range(0, len(text), PART):
                    got[lang] = got.get(lang, 0) + np.bincount(trigrams(text[i : i + PART])[0], minlength=BUCKETS)
        for lang, n in got.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "at": at, "n": n[at]})

    sums = sample.select("lang", "text").mapInPandas(count, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).collect()
    names = sorted({r.lang for r in sums})  # a language without a drawn row has no table: a flat one would win on what no other has seen
    table = np.empty((BUCKETS, len(names)), np.float32)
    by: dict[str, list] = {}
    for lang, at, n in sums:
        by.setdefault(lang, []).append((at, n))
    for k, lang in enumerate(names):
        column = np.full(BUCKETS, 0.05)
        for at, n in by[lang]:
            column[at] += n
        table[:, k] = np.log(column / column.sum())
    return names, table


def word_likelihoods(texts: list[str], logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihoods (word, language) and the words' number in each text."""
    out, many, held, size = [], np.zeros(len(texts), np.int64), [], 0

    def flush() -> None:
        if held:
            at, starts = trigrams("\n".join(held))
            if len(at):
                out.append(np.add.reduceat(logp[at], starts, axis=0))
            held.clear()

    for k, text in enumerate(texts):
        i = 0
        while i < len(text):
            end = i + PART
            while end < len(text) and text[end].isalpha() and end < i + PART + 1000:
                end += 1
            part = text[i:end]
            many[k] += _count_words(part)
            held.append(part)
            size += len(part)
            if size > PART:
                flush()
                size = 0
            i = end
    flush()
    return (np.concatenate(out) if out else np.zeros((0, logp.shape[1]), np.float32)), many


def _count_words(text: str) -> int:
    code = np.frombuffer(f" {text.lower()}".encode("utf-32-le", "replace"), np.uint32)
    letter = _is_letter()[code]
    return int((letter[1:] & ~letter[:-1]).sum())


def mixture(ll: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Proportions (document, language), after selection by penalised likelihood; documents of no words get zeros."""
    docs, langs = len(many), ll.shape[1]
    share = np.zeros((docs, langs))
    used = np.flatnonzero(many)
    if not len(used) or not langs:
        return share
    n = many[used]
    starts, owner = np.concatenate([[0], np.cumsum(n)[:-1]]), np.repeat(np.arange(len(used)), n)
    top = ll.max(1, keepdims=True)
    like = np.exp(np.maximum(ll - top, -60))

    def em(like: np.ndarray, allowed: np.ndarray, starts: np.ndarray, owner: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pi = allowed / allowed.sum(1, keepdims=True)
        for _ in range(ROUNDS):
            r = like * pi[owner]
            r /= r.sum(1, keepdims=True)
            pi = np.add.reduceat(r, starts, axis=0) / n[:, None]
        fit = np.add.reduceat(np.log((like * pi[owner]).sum(1) + 1e-300), starts)
        return pi, fit

    allowed = np.ones((len(used), langs))
    pi, fit = em(like, allowed, starts, owner, n)
    todo = np.arange(len(used))
    for _ in range(langs - 1):
        # drop the least language of the documents that are still open
        todo = todo[(allowed[todo].sum(1) > 1)]
        if not len(todo):
            break
        trial = allowed[todo].copy()
        trial[np.arange(len(todo)), np.where(trial > 0, pi[todo], 2).argmin(1)] = 0
        mask = np.isin(owner, todo) if len(todo) < len(used) else np.ones(len(owner), bool)
        m = n[todo]
        got, less = em(like[mask], trial, np.concatenate([[0], np.cumsum(m)[:-1]]), np.repeat(np.arange(len(todo)), m), m)
        better = fit[todo] - less < PENALTY * np.log(m + 1.0)
        ok = todo[better]
        allowed[ok], pi[ok], fit[ok] = trial[better], got[better], less[better]
        todo = ok
    share[used] = pi
    return share


def predict(documents: DataFrame, model: tuple[list[str], np.ndarray] | None = None) -> DataFrame:
    """Add lang_pred and lang_score to every document."""
    shared = documents.sparkSession.sparkContext.broadcast(model or fit(documents))  # BUCKETS x LANGUAGES floats at most

    @F.pandas_udf("lang_pred string, lang_score double")
    def guess(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names, logp = shared.value
        room = max(1 << 12, min(2 * PART, 4 * VALUES // max(1, len(names))))  # characters read at once, of several texts
        for s in parts:
            texts = [t or "" for t in s]
            name, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            step, i = 0, 0
            while i < len(texts) and names:
                step, size = i, 0
                while step < len(texts) and (step == i or size + len(texts[step]) <= room):
                    size += len(texts[step])
                    step += 1
                share = mixture(*word_likelihoods(texts[i:step], logp))
                best = share.argmax(1)
                top = share[np.arange(len(best)), best]
                name[i:step] = np.where(top > 0, np.array(names, object)[best], "und")
                score[i:step] = np.clip(top, 0, 1)
                i = step
            yield pd.DataFrame({"lang_pred": name, "lang_score": score})

    rest = [F.col(f"`{c}`") for c in documents.columns if c not in ("lang_pred", "lang_score")]
    both = free(documents, "__guess")
    return documents.withColumn(both, guess.asNondeterministic()("text")).select(*rest, f"{both}.lang_pred", f"{both}.lang_score")
