"""Attacks on texts, to see how far scores hold: Columns that stay in the JVM.

Places are drawn without replacement by a rule of their number and the text's
length, so that a text is always attacked in the same way and exactly the share
of a strength is changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentlens.functions.texts import let

# Replacements of words and of letters, what the strengths change, and the least share of texts still found after each attack.
SYNONYMS = {"the": "a", "is": "are", "was": "were", "good": "great", "bad": "poor", "big": "large", "small": "tiny", "use": "utilise", "show": "demonstrate", "make": "create", "get": "obtain"}
GLYPHS = {"a": "а", "e": "е", "o": "о", "p": "р", "c": "с"}
#: Sentences whose words lose their order; per cent of words; per cent of characters; per cent of characters, one at least.
STRENGTHS = {
    "shuffle": {"low": 1, "medium": 3, "high": 6}, "synonym": {"low": 5, "medium": 15, "high": 30},
    "zwsp": {"low": 1, "medium": 5, "high": 10}, "homoglyph": {"low": 1, "medium": 3, "high": 8},
}
CRITERIA = {"shuffle": 0.75, "synonym": 0.80, "zwsp": 0.85, "homoglyph": 0.80}
#: A character that does not show; multiplier and modulus of the draw: an odd multiplier gives every place a number of its own.
BLANK, TIMES, MODULUS = "\u200b", 2654435761, 1 << 32


def _share(many: Column, per_cent: int) -> Column:
    return F.floor(many * per_cent / 100).cast("int")


#: The lowest bits of a place or turn that are packed in a long, and how many more places than asked for are held to be under a bound of the draw.
_LOW, _SLACK = (1 << 31) - 1, 16


def _drawn(many: Column, n: Column) -> Column:
    """The first n of so many places that are drawn, ascending: the place above the lowest 31 bits, its turn in them.

    A place's number is its own and that of all places times a constant, so that numbers are even: those under a
    bound are hardly more than n, and only they are sorted.  If a bound should have fewer than n, all are.
    """
    number = lambda j: (j * F.lit(TIMES).cast("long")).bitwiseAND(F.lit(MODULUS - 1).cast("long"))
    every = F.sequence(many.cast("long"), F.greatest(2 * many.cast("long") - 1, many.cast("long")))
    bound = ((n + _SLACK) / F.greatest(many, F.lit(1)) * MODULUS).cast("long")
    low = F.lit(_LOW).cast("long")
    some = let(bound, lambda most: let(F.filter(every, lambda j: number(j) <= most), lambda c: F.when(F.size(c) >= n, c).otherwise(every)))
    drawn = F.slice(F.sort_array(F.transform(some, lambda j: F.shiftleft(number(j), 31).bitwiseOR(j - many))), F.lit(1), n)
    return F.sort_array(F.transform(drawn, lambda x, turn: F.shiftleft(x.bitwiseAND(low), 31).bitwiseOR(turn.cast("long"))))


def _segments(parts: Column, most: Column, changes: dict, glue: str) -> Column:
    """How many parts there are, what lies before the first of the ``most`` places that are drawn first, and what goes on from each of these: its turn, the text as it is, and with its first part changed in each way."""
    place = lambda x: F.shiftright(x, 31).cast("int")
    turn = lambda x: x.bitwiseAND(F.lit(_LOW).cast("long")).cast("int")

    def of(p: Column, many: Column, at: Column) -> Column:
        def segment(x: Column, j: Column) -> Column:
            rest = F.coalesce(place(F.get(at, j + 1)), many) - place(x) - 1
            tail = F.when(rest > 0, F.concat(F.lit(glue), F.array_join(F.slice(p, place(x) + 2, rest), glue))).otherwise("")
            both = lambda s: F.struct(turn(x).alias("turn"), F.concat(s["head"], s["tail"]).alias("plain"), *[F.concat(f(s["head"]), s["tail"]).alias(k) for k, f in changes.items()])
            return let(F.struct(F.get(p, place(x)).alias("head"), tail.alias("tail")), both)

        before = F.coalesce(place(F.get(at, F.lit(0))), many)
        lead = F.when(before > 0, F.array(F.array_join(F.slice(p, F.lit(1), before), glue))).otherwise(F.array().cast("array<string>"))
        return F.struct(many.alias("many"), lead.alias("lead"), F.transform(at, segment).alias("segments"))

    whole = lambda p: let(F.size(p), lambda many: let(_drawn(many, F.greatest(F.least(most(many), many), F.lit(0))), lambda at: of(p, many, at)))
    return let(parts, lambda p: F.when(p.isNotNull(), whole(p)))


def _changed(cut: Column, n, kind: str, glue: str) -> Column:
    """The text of such segments, with those changed whose turn is under n(how many parts there are)."""
    return let(n(cut["many"]), lambda most: F.array_join(F.concat(cut["lead"], F.transform(cut["segments"], lambda s: F.when(s["turn"] < most, s[kind]).otherwise(s["plain"]))), glue))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _chars(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def _sentences(text: Column) -> Column:
    return F.split(text, r"\. ", -1)


def _shuffled(sentence: Column) -> Column:
    order = F.array_sort(F.transform(_words(sentence), lambda w, i: F.struct(F.md5(F.concat_ws(":", i, w).cast("binary")).alias("o"), w.alias("w"))))
    return F.array_join(F.transform(order, lambda x: x["w"]), " ")


def _swapped(w: Column) -> Column:
    bare = F.regexp_replace(F.lower(w), "[.,;:]+$", "")
    new = F.try_element_at(F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair]), bare)
    return F.when(new.isNotNull(), F.replace(w, bare, new)).otherwise(w)


def _glyphed(c: Column) -> Column:
    return F.when(F.lower(c).isin(*GLYPHS), F.translate(F.lower(c), "".join(GLYPHS), "".join(GLYPHS.values()))).otherwise(c)


#: For each attack: parts of a text, how many of so many are drawn for an amount, what becomes of a part, and what joins them.
HOW = {
    "shuffle": (_sentences, lambda many, v: F.lit(v), _shuffled, ". "), "synonym": (_words, _share, _swapped, " "),
    "zwsp": (_chars, _share, lambda c: F.concat(F.lit(BLANK), c), ""), "homoglyph": (_chars, lambda many, v: F.greatest(F.lit(1), _share(many, v)), _glyphed, ""),
}


def _attack(kind: str, text: Column, amount: int) -> Column:
    parts, n, change, glue = HOW[kind]
    amounts = lambda many: n(many, amount)
    return let(_segments(parts(text), amounts, {kind: change}, glue), lambda cut: _changed(cut, amounts, kind, glue))


def shuffle_sentences(text: Column, sentences: int) -> Column:
    """The words of so many sentences, which end in a full stop and a space, are put in another order."""
    return _attack("shuffle", text, sentences)


def swap_synonyms(text: Column, per_cent: int) -> Column:
    """Of so many words, those of a short list give way to others; words are parted by single spaces after that."""
    return _attack("synonym", text, per_cent)


def insert_blanks(text: Column, per_cent: int) -> Column:
    """A zero-width space before so many characters."""
    return _attack("zwsp", text, per_cent)


def swap_glyphs(text: Column, per_cent: int) -> Column:
    """So many characters, one at least, give way to ones that look alike, if there are such."""
    return _attack("homoglyph", text, per_cent)


def attacked(df: DataFrame, text: str = "text") -> DataFrame:
    """Each row with its text under each attack at each strength: attack, strength and the text take the place of the text.

    Texts are cut and places drawn once for all attacks on parts of a kind, in columns of their own; names with two underscores in front are not for df.
    """
    rest = [c for c in df.columns if c != text]
    each = [(k, s, v) for k, by in STRENGTHS.items() for s, v in by.items()]
    amount = lambda k, v: lambda many: HOW[k][1](many, v)
    cuts = {}  # the attacks on parts of a kind, which have one glue
    for k, (cut, _, _, glue) in HOW.items():
        cuts.setdefault((cut, glue), []).append(k)
    name = lambda cut: f"__{cut.__name__}"
    most = lambda kinds: lambda many: F.greatest(F.lit(0), *[amount(k, v)(many) for k, _, v in each if k in kinds])
    cut = df.select(*rest, *[_segments(f(F.col(text)), most(kinds), {k: HOW[k][2] for k in kinds}, glue).alias(name(f)) for (f, glue), kinds in cuts.items()])
    some = [F.struct(F.lit(k).alias("attack"), F.lit(s).alias("strength"), _changed(F.col(name(HOW[k][0])), amount(k, v), k, HOW[k][3]).alias(text)) for k, s, v in each]
    return cut.select(*rest, F.explode(F.array(*some)).alias("__a")).select(*rest, "__a.*")


ATTACKS = {"shuffle": shuffle_sentences, "synonym": swap_synonyms, "zwsp": insert_blanks, "homoglyph": swap_glyphs}
