"""Text feature expressions.

Cue words (negations, hedges, intensifiers, negative prefixes) are whole words: one pattern extracts them, and every
family is counted on that short list. Patterns that need
look-around run only on texts that contain their fixed part. Word and sentence counts work on the text with
single blanks, where their patterns are simple.

Character classes are spelled out, so that results do not depend on the Java release. Single ASCII characters
are cheap in a class and each range or property is not, so the ASCII members are listed one by one and
everything beyond ASCII sits behind one range test.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from . import fixed
from .scalar import let, ratio

_ASCII_SPACES = r"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
_ASCII_MARKS = r"!\"#$%&'()*+,\-./:;<=>?@\[\\\]^`{|}~" + "".join(rf"\x{i:02x}" for i in [*range(9), *range(14, 28)])
_SPACE = rf"[{_ASCII_SPACES}[ -　&&[{fixed.WHITESPACE_RANGES}]]]"
_MARK = rf"[{_ASCII_MARKS}[\x7f-\x{{10FFFF}}&&[^\p{{L}}\p{{N}}{fixed.WHITESPACE_RANGES}]]]"
# A word character of a lower-cased text.
_WORD = rf"[{string.ascii_lowercase}{string.digits}_[\x80-\x{{10FFFF}}&&[\p{{L}}\p{{N}}]]]"

# "cannot" is one word; the others contain an apostrophe and are matched as patterns.
CONTRACTIONS = [w for w in fixed.NEGATION_CONTRACTIONS if "'" in w]
NEGATIONS = [w for w in [*fixed.NEGATION_WORDS, *fixed.NEGATION_CONTRACTIONS] if "'" not in w]
HEDGES = [*fixed.HEDGE_MODALS, *fixed.HEDGE_DEGREES]
INTENSIFIERS = [*fixed.INTENSIFIERS_STRONG, *fixed.INTENSIFIERS_MILD]
CUES = sorted({*NEGATIONS, *HEDGES, *fixed.HEDGE_LIKELIHOODS, *INTENSIFIERS})


def _whole(words: Sequence[str]) -> str:
    """Any of ``words`` between word boundaries; the first letter is tested before the look-behind."""
    initials = "".join(sorted({w[0] for w in words}))
    return f"(?=[{initials}])(?<!{_WORD})(?:{'|'.join(words)})(?!{_WORD})"


CONTRACTION_PATTERN = _whole(CONTRACTIONS)
PHRASE_PATTERN = _whole(fixed.HEDGE_PHRASES)
NEGATION_PATTERN = _whole([*fixed.NEGATION_WORDS, *fixed.NEGATION_CONTRACTIONS])
POLYSYLLABLE_PATTERN = "[aeiouy]++[^ aeiouy]++[aeiouy]++[^ aeiouy]++[aeiouy][^ ]*+"  # in a single-spaced text


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _has_prefix(word: Column) -> Column:
    found = F.startswith(word, F.lit(fixed.NEGATION_PREFIXES[0]))
    for p in fixed.NEGATION_PREFIXES[1:]:
        found = found | F.startswith(word, F.lit(p))
    return found


def _cue_pattern() -> str:
    """A whole word that is a cue or begins with a negative prefix; the first letter is tested before everything else."""
    initials = "".join(sorted({w[0] for w in [*CUES, *fixed.NEGATION_PREFIXES]}))
    prefixed = f"(?:{'|'.join(fixed.NEGATION_PREFIXES)}){_WORD}*+"
    return f"(?=[{initials}])(?<!{_WORD})(?:{prefixed}|(?:{'|'.join(CUES)})(?!{_WORD}))"


CUE_PATTERN = _cue_pattern()


def cue_words(text: Column) -> Column:
    """The cue words of a text, lower-cased, repeats included."""
    return F.regexp_extract_all(F.lower(text), F.lit(CUE_PATTERN), 0)


def count_cues(cues: Column, words: Sequence[str]) -> Column:
    return F.size(F.filter(cues, lambda w: w.isin(list(words))))


def count_prefixed(cues: Column) -> Column:
    return F.size(F.filter(cues, _has_prefix))


def contraction_count(text: Column) -> Column:
    low = F.lower(text)
    return F.when(F.contains(low, F.lit("n't")), _count(low, CONTRACTION_PATTERN)).when(text.isNotNull(), 0)


def phrase_count(text: Column) -> Column:
    low = F.lower(text)
    possible = F.contains(low, F.lit(fixed.HEDGE_PHRASES[0]))
    for p in fixed.HEDGE_PHRASES[1:]:
        possible = possible | F.contains(low, F.lit(p))
    return F.when(possible, _count(low, PHRASE_PATTERN)).when(text.isNotNull(), 0)


def text_hash(text: Column) -> Column:
    """First 16 hexadecimal digits of the SHA-256 of the UTF-8 text."""
    return F.substring(F.sha2(text, 256), 1, fixed.HASH_PREFIX)


def text_preview(text: Column, length: int = fixed.PREVIEW_LENGTH) -> Column:
    return F.when(F.length(text) <= length, text).otherwise(
        F.concat(F.substring(text, 1, length), F.lit("..."))
    )


def char_count(text: Column) -> Column:
    return F.length(text)


def single_spaced(text: Column) -> Column:
    """Words of a text with exactly one blank between them."""
    return F.regexp_replace(F.btrim(text, F.lit(fixed.WHITESPACE)), f"{_SPACE}+", " ")


def blank_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def spaced_words(spaced: Column) -> Column:
    """Number of words of a single-spaced text."""
    return F.when(spaced == "", 0).otherwise(blank_count(spaced) + 1)


def spaced_letters(spaced: Column) -> Column:
    return F.length(F.replace(spaced, F.lit(" "), F.lit("")))


def word_count(text: Column) -> Column:
    """Number of runs of non-white-space characters."""
    return let(single_spaced(text), spaced_words)


def sentence_count(text: Column) -> Column:
    """Pieces between runs of ``.!?``, empty pieces included."""
    return _count(text, "[.!?]+") + 1


def avg_word_length(text: Column) -> Column:
    average = let(single_spaced(text), lambda t: ratio(spaced_letters(t), spaced_words(t)))
    return F.when(text.isNotNull(), average)


def punctuation_count(text: Column) -> Column:
    """Characters that are neither of a word nor white space."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{_MARK}+", ""))


def caps_count(text: Column) -> Column:
    return _count(text, "[A-Z]")


def per_char(count: Column, text: Column) -> Column:
    return count / F.greatest(F.length(text), F.lit(1))


def punctuation_ratio(text: Column) -> Column:
    return per_char(punctuation_count(text), text)


def caps_ratio(text: Column) -> Column:
    return per_char(caps_count(text), text)


def negation_prefix_count(text: Column) -> Column:
    return count_prefixed(cue_words(text))


def negation_count(text: Column) -> Column:
    """Words and contractions plus words with a negative prefix; "none" scores in both."""
    return let(cue_words(text), lambda w: count_cues(w, NEGATIONS) + count_prefixed(w)) + contraction_count(text)


def double_negation(text: Column) -> Column:
    """1.0 if some sentence holds two negation words or more."""
    return F.rlike(F.lower(text), F.lit(f"{NEGATION_PATTERN}[^.!?]*{NEGATION_PATTERN}")).cast("double")


def uncertainty_markers(text: Column) -> Column:
    return count_cues(cue_words(text), fixed.HEDGE_LIKELIHOODS) + phrase_count(text)


def hedge_count(text: Column) -> Column:
    return count_cues(cue_words(text), [*HEDGES, *fixed.HEDGE_LIKELIHOODS]) + phrase_count(text)


def intensifier_count(text: Column) -> Column:
    return let(
        cue_words(text), lambda w: count_cues(w, fixed.INTENSIFIERS_STRONG) + count_cues(w, fixed.INTENSIFIERS_MILD)
    )


def _lexicon(text: Column, words: Sequence[str]) -> Column:
    lowered = F.lower(text)
    total = F.contains(lowered, F.lit(words[0])).cast("int")
    for w in words[1:]:
        total = total + F.contains(lowered, F.lit(w)).cast("int")
    return total


def positive_word_count(text: Column) -> Column:
    """How many of the six positive words occur, as substrings."""
    return _lexicon(text, fixed.POSITIVE_WORDS)


def negative_word_count(text: Column) -> Column:
    return _lexicon(text, fixed.NEGATIVE_WORDS)


def spoken_sentences(spaced: Column) -> Column:
    """Number of non-blank sentences of a single-spaced text."""
    return _count(spaced, "[^.!? ][^.!?]*")


def sentence_words(spaced: Column) -> Column:
    """Words summed over sentences: a word with an inner full stop counts on both sides of it.

    Words, plus the stops that a sentence goes on after without a blank, less the words that start with
    a stop (these were either counted twice or are nothing but stops).
    """
    inner = _count(spaced, "[.!?]+(?=[^.!? ])")
    leading = _count(spaced, " [.!?]") + F.rlike(spaced, F.lit("^[.!?]")).cast("int")
    return spaced_words(spaced) + inner - leading


def avg_sentence_length(text: Column) -> Column:
    average = let(single_spaced(text), lambda t: ratio(sentence_words(t), spoken_sentences(t)))
    return F.when(text.isNotNull(), average)


def flesch_from(avg_len: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(100.0) - avg_len * 2)


def flesch_approx(text: Column) -> Column:
    return flesch_from(avg_sentence_length(text))


def syllable_count(text: Column) -> Column:
    """Vowel groups."""
    return _count(F.lower(text), "[aeiouy]+")


def polysyllable_count(spaced: Column) -> Column:
    """Words with three vowel groups or more, of a single-spaced text."""
    return _count(F.lower(spaced), POLYSYLLABLE_PATTERN)


def flesch_kincaid_grade(words: Column, sentences: Column, syllables: Column) -> Column:
    return F.when(
        words > 0, 0.39 * words / F.greatest(sentences, F.lit(1)) + 11.8 * F.try_divide(syllables, words) - 15.59
    ).otherwise(0.0)


def gunning_fog(words: Column, sentences: Column, polysyllables: Column) -> Column:
    return F.when(
        words > 0, 0.4 * (words / F.greatest(sentences, F.lit(1)) + 100.0 * F.try_divide(polysyllables, words))
    ).otherwise(0.0)


def smog_index(sentences: Column, polysyllables: Column) -> Column:
    return F.when(
        sentences > 0, 1.043 * F.sqrt(polysyllables * 30.0 / F.greatest(sentences, F.lit(1))) + 3.1291
    ).otherwise(0.0)
