"""Statistics of whole texts, vectorised over slices of documents; inputs of the quality and toxicity scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import kernels as K

#: Byte classes.
UPPER, LOWER, DIGIT, SPACE, LINE, STOP, SHOUT, MARK, SYMBOL, HIGH = range(10)
_CLASS = np.full(256, SYMBOL, np.int64)
for _bytes, _kind in (
    (range(65, 91), UPPER), (range(97, 123), LOWER), (range(48, 58), DIGIT), ((9, 11, 12, 13, 32), SPACE), ((10,), LINE),
    (b".", STOP), (b"!?", SHOUT), (b",;:'\"()-", MARK), (range(128, 256), HIGH),
):
    for _b in _bytes:
        _CLASS[_b] = _kind
_ALNUM = np.isin(_CLASS, (UPPER, LOWER, DIGIT, HIGH))

QUALITY = [
    "log_bytes", "log_words", "word_length", "upper_share", "digit_share", "stop_share", "shout_share", "mark_share", "symbol_share", "high_share",
    "line_share", "distinct_words", "top_word_share", "repeat_next", "distinct_shingles", "caps_words", "symbol_words", "bare_words", "short_words",
    "long_words", "distinct_lines",
]


class Slice:
    """Words and byte classes of a slice of documents."""

    def __init__(self, texts: pa.Array):
        self.data, self.off = K.utf8(texts)
        self.docs = len(self.off) - 1
        self.starts, self.ends, self.first = K.words(self.data, self.off)
        self.kind = _CLASS[self.data]
        self.bytes = np.diff(self.off)
        self.words = np.diff(self.first)
        place = np.repeat(np.arange(self.docs) * 10, self.bytes)
        self.count = np.bincount(place + self.kind, minlength=self.docs * 10).reshape(self.docs, 10)
        self.hashes = K.word_hashes(self.data, self.starts, self.ends)
        self.length = self.ends - self.starts

    def per_word(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each word the mask holds."""
        total = np.concatenate(([0], np.cumsum(mask)))
        return total[self.ends] - total[self.starts]

    def share(self, flags: np.ndarray) -> np.ndarray:
        """Share of each document's words that are flagged."""
        total = np.concatenate(([0], np.cumsum(flags)))
        return (total[self.first[1:]] - total[self.first[:-1]]) / np.maximum(self.words, 1)


def _distinct(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the count of the most common one, by segment."""
    n, top = np.zeros(len(off) - 1), np.zeros(len(off) - 1)
    for i in range(len(n)):
        x = np.sort(values[off[i] : off[i + 1]])
        if len(x):
            at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1], [True])))
            n[i], top[i] = len(at) - 1, np.diff(at).max()
    return n, top


def quality_stats(texts: pa.Array) -> np.ndarray:
    """One row of QUALITY statistics per text; all are 0 for a null or empty text."""
    s = Slice(texts)
    c, nbytes, nwords = s.count, np.maximum(s.bytes, 1), np.maximum(s.words, 1)
    letters = np.maximum(c[:, UPPER] + c[:, LOWER], 1)
    distinct, top = _distinct(s.hashes, s.first)
    flat, cut = K.shingles(s.hashes, s.first)
    different, _ = _distinct(flat, cut)
    upper, symbol = s.per_word(s.kind == UPPER), s.per_word(np.isin(s.kind, (SYMBOL, SHOUT)))
    again = np.zeros(len(s.hashes), bool)
    again[1:] = s.hashes[1:] == s.hashes[:-1]
    again[s.first[:-1][s.first[:-1] < len(again)]] = False
    breaks = np.unique(np.concatenate((s.off, np.flatnonzero(s.kind == LINE) + 1)))
    starts, ends = breaks[:-1], breaks[1:]
    line_first = np.searchsorted(starts, s.off)
    lines = np.diff(line_first)
    distinct_lines, _ = _distinct(K.word_hashes(s.data, starts, ends), line_first)
    cols = [
        np.log1p(s.bytes), np.log1p(s.words), K.segment_sums(s.length, s.first) / nwords, c[:, UPPER] / letters, c[:, DIGIT] / nbytes,
        c[:, STOP] / nbytes, c[:, SHOUT] / nbytes, c[:, MARK] / nbytes, c[:, SYMBOL] / nbytes, c[:, HIGH] / nbytes, c[:, LINE] / nbytes, distinct / nwords,
        top / nwords, s.share(again), different / np.maximum(np.diff(cut), 1), s.share((upper == s.length) & (s.length > 1) | (upper > 1) & (upper + symbol >= s.length - 1)),
        s.share((symbol > 0)), s.share(symbol == s.length), s.share(s.length <= 2), s.share(s.length > 12), distinct_lines / np.maximum(lines, 1),
    ]
    return np.stack([np.asarray(x, float) for x in cols], axis=1)


TOXIC = [
    "lexicon_density", "lexicon_distinct", "seed_density", "lexicon_any", "second_person", "near_second_person", "log_words", "upper_share", "caps_words", "shout_share",
    "mark_share", "symbol_share", "obfuscated_words", "stretched_words",
]

#: Insults that seed the lexicon, and second-person words of the languages at hand.
SEED_WORDS = "idiot moron stupid loser scum trash clown pathetic worthless disgusting dumb fool jerk imbecile filth garbage vermin".split()
SECOND_PERSON = "you your yours yourself du dich dir dein deine ihr euch tu te toi ton tes vous votre vos usted ustedes vosotros tus ti".split()

#: Characters that stand for letters in disguised words.
_DISGUISE = dict(zip(b"013457@$|", b"oieastasi", strict=True))
_PLAIN = K.LOWER.copy()
for _b, _letter in _DISGUISE.items():
    _PLAIN[_b] = _letter


def lexicon_hashes(words) -> np.ndarray:
    data, off = K.utf8(pa.array(list(words), pa.string()))
    return np.unique(K.word_hashes(_PLAIN[data], off[:-1], off[1:]))


def bare_words(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words without the marks around them (starts, ends; equal for a word of marks only) and the hashes of their plain forms."""
    solid = _ALNUM[s.data] | np.isin(s.data, list(b"@$"))
    at = np.append(np.flatnonzero(solid), len(s.data))
    lo = at[np.searchsorted(at[:-1], s.starts)]
    hi = np.searchsorted(at[:-1], s.ends) - 1
    hi = np.where(hi >= 0, at[np.maximum(hi, 0)] + 1, 0)
    lo = np.minimum(lo, s.ends)
    hi = np.maximum(hi, lo)
    hi = np.where(lo >= s.ends, lo, hi)
    return lo, hi, K.word_hashes(_PLAIN[s.data], lo, hi)


def _member(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among) or not len(x):
        return np.zeros(len(x), bool)
    return among[np.minimum(np.searchsorted(among, x), len(among) - 1)] == x


def toxic_stats(texts: pa.Array, lexicon: np.ndarray, reach: int = 6) -> np.ndarray:
    """One row of TOXIC statistics per text; all are 0 for a null or empty text."""
    s = Slice(texts)
    c, nbytes = s.count, np.maximum(s.bytes, 1)
    letters = np.maximum(c[:, UPPER] + c[:, LOWER], 1)
    _, _, plain = bare_words(s)
    bad, seed, you = _member(plain, lexicon), _member(plain, lexicon_hashes(SEED_WORDS)), _member(plain, lexicon_hashes(SECOND_PERSON))
    owner = np.repeat(np.arange(s.docs), s.words)
    total = np.concatenate(([0], np.cumsum(you)))
    at = np.flatnonzero(bad)
    low, high = np.maximum(at - reach, s.first[:-1][owner[at]]), np.minimum(at + reach + 1, s.first[1:][owner[at]])
    near = np.zeros(len(bad), bool)
    near[at] = total[high] > total[low]
    distinct = np.zeros(s.docs)
    pair = np.unique(np.stack((owner[at].astype(np.uint64), plain[at])), axis=1) if len(at) else np.zeros((2, 0), np.uint64)
    np.add.at(distinct, pair[0].astype(np.int64), 1)
    upper = s.per_word(s.kind == UPPER)
    letter = s.per_word((s.kind == UPPER) | (s.kind == LOWER))
    odd = np.zeros(len(s.data), bool)
    odd[_inner(s)] = True
    same = np.zeros(len(s.data), bool)
    same[2:] = (s.data[2:] == s.data[1:-1]) & (s.data[1:-1] == s.data[:-2]) & ((s.kind[2:] == LOWER) | (s.kind[2:] == UPPER))
    cols = [
        1000 * s.share(bad), distinct, 1000 * s.share(seed), s.share(bad) > 0, s.share(you), 1000 * s.share(near), np.log1p(s.words), c[:, UPPER] / letters,
        s.share((upper == letter) & (letter > 1)), c[:, SHOUT] / nbytes, c[:, MARK] / nbytes, c[:, SYMBOL] / nbytes, s.share((s.per_word(odd) > 0) & (letter > 1)), s.share(s.per_word(same) > 0),
    ]
    return np.stack([np.asarray(x, float) for x in cols], axis=1)


def _inner(s: Slice) -> np.ndarray:
    """Bytes with a digit or symbol between two letters of a word."""
    letter = (s.kind == UPPER) | (s.kind == LOWER) | (s.kind == HIGH)
    odd = (s.kind == DIGIT) | (s.kind == SYMBOL)
    mid = np.flatnonzero(odd[1:-1] & letter[:-2] & letter[2:]) + 1 if len(s.data) > 2 else np.zeros(0, np.int64)
    return mid
