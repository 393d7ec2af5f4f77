"""Languages of subtitle files and of their cues by nearest centroids.

A cue is the sum of the TF-IDF vectors of its words' character n-grams (pairs and triples with the word's edges, and the
whole word), scaled to length one. Every language has several centroids, clustered from the cues of a bounded sample of
labelled files, drawn from each language on its own; the sample first loses what its own means contradict, so wrong labels
and foreign passages don't make clusters. A cue has the language of the nearest centroid by cosine, or none if even that
is too far. All cues of a file are classified where the file is read; nothing is shuffled.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.plans.spread import spread

#: The languages and what labels call them.
LANGUAGES = {
    "da": ("dan", "danish"), "de": ("deu", "ger", "german"), "en": ("eng", "english"), "es": ("spa", "spanish"),
    "fr": ("fra", "fre", "french"), "it": ("ita", "italian"), "nl": ("nld", "dut", "dutch"), "pl": ("pol", "polish"),
    "pt": ("por", "portuguese"), "ru": ("rus", "russian"), "sv": ("swe", "swedish"), "tr": ("tur", "turkish"),
}
CODES = list(LANGUAGES)
NAMED = {n: code for code, names in LANGUAGES.items() for n in (code, *names)}

#: Labelled files of each language that the centroids are fitted on at most, centroids per language, n-grams kept.
SAMPLE_FILES, CENTROIDS, FEATURES = 125, 8, 80_000
#: Numbers for n-grams that aren't kept; they have no weight in a centroid, but one in the length of a cue.
UNKNOWN = 1 << 16
#: Rounds that add a centroid to each language whose cues others come too near.
REPAIRS = 8
#: Share of a language's cues that must be so near to another for a centroid to be added.
REPAIR_SHARE = 0.0003
#: Weight of an n-gram that all languages use alike, against 1 more for one that a single language uses.
SHARED = 0.05
#: Lead of another language, as a share of its cosine, from which on a training cue isn't taken to be of its file's label.
CONTRADICTION = 0.3
#: A cue nearer than this share of the training cues' usual cosine to no centroid has no language.
REJECT = 0.45
#: By how much a foreign language must beat the file's own, as a share of its cosine, alone and beside cues of the same.
MARGIN, MARGIN_BESIDE = 0.2, 0.04
#: Lead of the nearest language, as a share of its cosine, under which the sentences of a cue vote.
UNSURE = 0.6
CACHE_WORDS = 300_000

TIME_LINE = re.compile(r"^[^\n]*-->[^\n]*", re.M)
_NOISE = re.compile(r"<[^>\x00]{0,200}>|\[[^\]\x00]*\]|\([^)\x00]*\)|\{[^}\x00]*\}|\*[^*\x00]*\*")
#: Top-level domains, and the crafts of who makes subtitles, of which a credit names two.
_TOP = r"(?:example|invalid|test|com|net|org|info|tv|io)\b"
_CRAFT = r"\b(?:[Tt]ranslat|[Tt]imed|[Tt]iming|[Ss]ync|[Cc]orrect|[Ss]ubtitl)\w*"
#: Addresses, of which one with spaces about its dot needs a host with a hyphen or digit after a letter, marks, and credits.
_ADVERT = re.compile(
    rf"https?:|www\.|@|►|◄|\(dot\)|\[dot\]|[^\W_]\.{_TOP}|(?<=[^\W\d_])[\d-][^\W_]* ?\. ?{_TOP}"
    rf"|{_CRAFT} (?:&|and) {_CRAFT}|[Ss]ubtitles by|[Rr]ate this (?:sub|file)"
)
#: The number of the next cue, behind an empty line; letters that recognition takes for digits count as such.
_NUMBER = re.compile(r"\n[ \t]*\n[ \t]*[\dlIOoSB|]{1,6}\s*(?=\x00)")
_WORD = re.compile(r"[^\W\d_]+|[\x00.!?…]")
#: What stands between sentences; \x00 stands between cues.
STOPS = ".!?…"


#: What a byte from 0x80 on looks like when a UTF-8 text is read as Windows-1252; bytes without a character there stay.
_BYTES = {bytes([i]).decode("cp1252", "ignore") or chr(i): i for i in range(0x80, 0x100)} | {chr(i): i for i in range(0x80, 0xA0)}
_HIGH = "".join(map(re.escape, sorted(_BYTES)))
_MANGLED = re.compile(f"[Â-ô][{''.join(map(re.escape, sorted(c for c, b in _BYTES.items() if b < 0xC0)))}]")
_HIGH_RUN = re.compile(f"[{_HIGH}]+")


def _unmangle(m: re.Match) -> str:
    try:
        return bytes(map(_BYTES.__getitem__, m.group())).decode()
    except UnicodeDecodeError:
        return m.group()


def repair(text: str) -> str:
    """``text`` with UTF-8 that was read as Windows-1252, once or up to three times, read as UTF-8 again."""
    for _ in range(3):
        if not _MANGLED.search(text):
            break
        text, before = _HIGH_RUN.sub(_unmangle, text), text
        if text == before:
            break
    return text


def label_language(label: str | None) -> str | None:
    """The language a label names: two- or three-letter code, regional tag or English name, in any case; else None."""
    words = re.findall(r"[^\W\d_]+", (label or "").lower())
    if not words:
        return None
    return NAMED.get(words[0]) or next((NAMED[w] for w in words[1:] if len(w) > 3 and w in NAMED), None)


def _without_adverts(joined: str) -> str:
    """``joined`` without the lines that hold an advert."""
    parts, end = [], 0
    for m in _ADVERT.finditer(joined):
        if m.start() < end:
            continue
        start = max(joined.rfind(c, end, m.start()) for c in "\n\x00") + 1
        parts.append(joined[end : max(start, end)])
        stops = [i for i in (joined.find(c, m.end()) for c in "\n\x00") if i >= 0]
        end = min(stops) if stops else len(joined)
    return "".join([*parts, joined[end:]]) if parts or end else joined


def cue_words(text: str | None) -> list[str]:
    """The words spoken in all cues, in lower case, and the STOPS; ``\\x00`` before those of each cue."""
    if not text:
        return []
    bodies = TIME_LINE.split(text.replace("\r\n", "\n").replace("\r", "\n").replace("\x00", " "))[1:]
    if not bodies:
        return []
    joined = "\x00".join(["", *bodies, ""])
    joined = _NUMBER.sub("\n", joined)
    if "&" in joined:
        joined = html.unescape(joined)
    return _WORD.findall(_NOISE.sub(" ", _without_adverts(repair(joined))).lower())[:-1]


def grams(word: str) -> list[str]:
    """The n-grams of a word."""
    w = f" {word} "
    return [w[i : i + n] for n in (2, 3) for i in range(len(w) - n + 1)] + ([w] if len(w) > 4 else [])


class Model:
    """N-grams with their weights, and centroids with their languages."""

    def __init__(self, index: dict[str, int], idf: np.ndarray, centroids: np.ndarray, of: np.ndarray, usual: float):
        self.index, self.idf, self.centroids, self.of, self.usual = index, idf, centroids, of, usual

    def word_rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word its products with the centroids, the numbers of its n-grams, and where each word's end."""
        flat, ends = [], []
        get, n = self.index.get, len(self.index)
        for w in words:
            flat += [n + (zlib.crc32(g.encode("utf-8", "surrogatepass")) & (UNKNOWN - 1)) if (i := get(g)) is None else i for g in grams(w)]
            ends.append(len(flat))
        flat, ends = np.array(flat, np.int64), np.array(ends, np.int64)
        known = flat < n
        total = np.zeros((len(flat) + 1, self.centroids.shape[0]), np.float32)
        np.cumsum(self.centroids[:, np.where(known, flat, 0)].T * np.where(known, self.idf[np.where(known, flat, 0)], 0)[:, None], axis=0, out=total[1:])
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        return total[ends] - total[starts], flat.astype(np.uint32), ends

    def lengths(self, cue: np.ndarray, gram: np.ndarray, n: int) -> np.ndarray:
        """The lengths of the vectors of cues 0 to n-1, of which each (cue, gram) is an n-gram; cues must ascend."""
        weights = np.append(self.idf, np.full(UNKNOWN, self.idf.max(), self.idf.dtype)).astype(np.float64)
        step = (2**32 - 1) // len(weights)
        square = np.zeros(n)
        for low in range(0, n, step):
            a, b = np.searchsorted(cue, (low, low + step))
            if a == b:
                continue
            key = np.sort((cue[a:b] - low).astype(np.uint32) * np.uint32(len(weights)) + gram[a:b])
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            count = np.diff(np.append(first, len(key)))
            key = key[first]
            at = key // np.uint32(len(weights))
            size = min(step, n - low)
            square[low : low + size] = np.bincount(at, (weights[key - at * np.uint32(len(weights))] * count) ** 2, size)
        return np.sqrt(np.maximum(square, 1e-18))


class Classifier:
    """Scores of cues under a model; remembers the rows of words it has met."""

    def __init__(self, model: Model):
        self.model, self.languages = model, [np.flatnonzero(model.of == i) for i in range(len(CODES))]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {c: i for i, c in enumerate("\x00" + STOPS)}
        n = len(self.known)
        self.rows, self.letters = np.zeros((n, self.model.centroids.shape[0]), np.float32), np.zeros(n, np.int64)
        self.grams, self.ends = np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)

    def __call__(self, texts: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text of :func:`cue_words` the positions of the cues with speech, their cosines by language, and votes.

        In a cue of several sentences few but telling words of one could outweigh the others. So where the nearest
        language doesn't lead clearly, the sentences vote by their letters: a row of votes is the share of the letters of each
        language, or zeros where there was no vote or it was for the nearest language.
        """
        if len(self.known) > CACHE_WORDS:
            self._forget()
        known = self.known
        flat = [w for t in texts for w in t]
        new = [w for w in dict.fromkeys(flat) if w not in known]
        for s in range(0, len(new), 4096):
            some = new[s : s + 4096]
            rows, own, ends = self.model.word_rows(some)
            known.update(zip(some, range(len(self.rows), len(self.rows) + len(some))))
            self.rows, self.ends = np.concatenate([self.rows, rows]), np.concatenate([self.ends, len(self.grams) + ends])
            self.grams = np.concatenate([self.grams, own])
            self.letters = np.concatenate([self.letters, np.array([len(w) for w in some])])
        ids = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
        sizes = np.array([len(t) for t in texts], np.int64)
        text = np.repeat(np.arange(len(texts)), sizes)
        opens = ids == 0
        before = np.concatenate([[0], np.cumsum(np.bincount(text[opens], minlength=len(texts)))])
        cue = np.cumsum(opens)
        has_words = np.bincount(cue, self.letters[ids], before[-1] + 1) > 0
        spoken = ~opens & has_words[cue]
        cue, ids, text = cue[spoken], ids[spoken], text[spoken]
        if not len(ids):
            return [(np.zeros(0, np.int64), *[np.zeros((0, len(CODES)), np.float32)] * 2)] * len(texts)
        starts = np.flatnonzero(np.concatenate([[True], cue[1:] != cue[:-1]]))
        sizes = self.ends[ids + 1] - self.ends[ids]
        place = np.repeat(self.ends[ids] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        number = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ids))))
        length = self.model.lengths(np.repeat(number, sizes), self.grams[place], len(starts))
        scores = np.add.reduceat(self.rows[ids], starts, axis=0) / length[:, None]
        by_language = np.stack([scores[:, own].max(1) if len(own) else np.full(len(starts), -1, np.float32) for own in self.languages], 1)
        votes = self._vote(by_language, ids, np.append(starts, len(ids)))
        position, at = cue[starts], np.searchsorted(text[starts], np.arange(len(texts) + 1))
        return [(position[a:b] - before[i], by_language[a:b], votes[a:b]) for i, (a, b) in enumerate(zip(at, at[1:]))]

    def _vote(self, scores: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        shares = np.zeros_like(scores)
        stop = (ids > 0) & (ids <= len(STOPS))
        inner = np.add.reduceat(stop & ~np.append(stop[1:], True), bounds[:-1]) > 0  # a stop before another word
        best = scores.argmax(1)
        top, next_ = scores[np.arange(len(scores)), best], np.partition(scores, -2, axis=1)[:, -2]
        for c in np.flatnonzero(inner & ((top - next_) < UNSURE * top)):
            own = ids[bounds[c] : bounds[c + 1]]
            sentence = np.cumsum(own <= len(STOPS))
            letters = np.bincount(sentence, self.letters[own])
            sums = np.zeros((len(letters), self.rows.shape[1]), np.float32)
            np.add.at(sums, sentence, self.rows[own])
            each = np.stack([sums[:, x].max(1) if len(x) else np.zeros(len(sums)) for x in self.languages], 1)
            first, second = each.max(1), np.partition(each, -2, axis=1)[:, -2]
            language = np.where(first - second >= MARGIN * first, each.argmax(1), best[c])
            votes = np.bincount(language, letters, scores.shape[1])
            most = int(votes.argmax())
            if most != best[c] and votes[most] > votes[best[c]]:
                shares[c] = votes / votes.sum()
        return shares


def decide(positions: np.ndarray, scores: np.ndarray, votes: np.ndarray, usual: float) -> tuple[int, float, list[tuple[int, int, float]]]:
    """Main language (-1: none), its share of the cues with a language, and (position, language, confidence) of foreign cues."""
    if not len(positions):
        return -1, 0.0, []
    at = np.arange(len(positions))
    voted = votes.max(1) > 0
    top = scores.max(1)
    best = np.where(voted, votes.argmax(1), scores.argmax(1))
    sure = top >= REJECT * usual
    if not sure.any():
        return -1, 0.0, []
    counts = np.bincount(best[sure], minlength=scores.shape[1])
    weight = np.array([top[sure & (best == i)].sum() for i in range(scores.shape[1])])
    main = int(np.lexsort((weight, counts))[-1])
    lead = np.where(voted, (votes[at, best] - votes[:, main]) / np.maximum(votes[at, best], 1e-9), (top - scores[:, main]) / np.maximum(top, 1e-9))
    strong = sure & (best != main) & (lead >= MARGIN)
    language = np.where(strong, best, -1)
    foreign = []
    for i in np.flatnonzero(sure & (best != main)):
        beside = {language[j] for j in (i - 1, i + 1) if 0 <= j < len(best)}
        if strong[i] or (best[i] in beside and lead[i] >= MARGIN_BESIDE):
            second = np.partition(scores[i], -2)[-2]
            foreign.append((int(positions[i]), int(best[i]), float(votes[i, best[i]] if voted[i] else top[i] / (top[i] + max(second, 0.0)))))
    return main, float(counts[main] / counts.sum()), foreign


def fit(rows: list[tuple[str, str]]) -> Model | None:
    """A model from (label, text) rows; None if no label names a language."""
    files = [(CODES.index(code), words) for label, text in rows if (code := label_language(label)) and len(words := cue_words(text)) > 1]
    if not files:
        return None
    vocabulary: dict[str, int] = {"\x00": 0}
    cue_of, word_of, file_of, n = [], [], [], 0
    for f, (_, words) in enumerate(files):
        for w in words:
            if w == "\x00":
                n += 1
                file_of.append(f)
            elif w not in STOPS:
                word_of.append(vocabulary.setdefault(w, len(vocabulary)))
                cue_of.append(n - 1)
    if not word_of:
        return None
    cue, word, file = np.array(cue_of), np.array(word_of), np.array(file_of)
    index: dict[str, int] = {}
    gram_of, of_word = [], []
    for w, i in vocabulary.items():
        if i:
            own = [index.setdefault(g, len(index)) for g in grams(w)]
            gram_of += own
            of_word += [i] * len(own)
    gram, of_word = np.array(gram_of), np.array(of_word)
    bounds = np.searchsorted(of_word, np.arange(len(vocabulary) + 1))
    # Files that have each n-gram, from the distinct words of each file.
    pairs = np.unique(file[cue] * len(vocabulary) + word)
    pf, pw = pairs // len(vocabulary), pairs % len(vocabulary)
    counts = bounds[pw + 1] - bounds[pw]
    flat = np.repeat(bounds[pw] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    df = np.bincount(np.unique(np.repeat(pf, counts) * len(index) + gram[flat]) % len(index), minlength=len(index))
    kept = np.sort(np.argsort(-df, kind="stable")[:FEATURES])
    idf = np.zeros(len(index))
    idf[kept] = np.log(1 + len(files) / df[kept])
    # How often each n-gram is in each cue.
    counts = bounds[word + 1] - bounds[word]
    place = np.repeat(bounds[word] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    key = np.repeat(cue, counts) * len(index) + gram[place]
    del place, counts
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    often = np.diff(np.append(first, len(key))).astype(np.float32)
    key = key[first]
    in_cue, gram_there = (key // len(index)).astype(np.int32), (key % len(index)).astype(np.int32)
    del key, first
    spoken = np.bincount(cue, minlength=n) > 0
    label = np.array([f[0] for f in files])[file]
    present = np.unique(label)

    def weigh(factor: np.ndarray) -> None:
        nonlocal weights, length
        weights = (idf * factor)[gram]
        length = np.sqrt(np.maximum(np.bincount(in_cue, ((idf * factor)[gram_there] * often) ** 2, n), 1e-9))

    def centroid(cues: np.ndarray) -> np.ndarray:
        use = cues[cue]
        share = np.bincount(word[use], 1 / length[cue[use]], len(vocabulary))
        c = np.bincount(gram, share[of_word] * weights, len(index))
        return c / max(np.linalg.norm(c), 1e-9)

    def scores(centroids: np.ndarray, cues: np.ndarray | None = None) -> np.ndarray:
        """Cosines of all cues, or of those in ``cues`` with 0 for the others."""
        use = slice(None) if cues is None else cues[cue]
        own_cue, own_word, columns = cue[use], word[use], []
        for c in centroids:
            rows = np.bincount(of_word, weights * c[gram], len(vocabulary))
            columns.append(np.bincount(own_cue, rows[own_word], n) / length)
        return np.stack(columns, 1)

    weights = length = np.zeros(0)
    factor = np.ones(len(index))
    good = spoken.copy()
    for _ in range(3):  # first the means, without what they contradict
        weigh(factor)
        near = scores(np.stack([centroid(good & (label == i)) for i in present]))
        best, top = present[near.argmax(1)], near.max(1)
        agree = np.bincount(file[spoken], (best == label)[spoken], len(files)) / np.maximum(np.bincount(file[spoken], minlength=len(files)), 1)
        own = near[np.arange(n), np.searchsorted(present, label)]
        good = spoken & (top - own <= CONTRADICTION * top) & (agree >= 0.5)[file]
        # N-grams that all languages use alike say nothing of the language.
        used = np.stack([np.bincount(gram, np.bincount(word[(good & (label == i))[cue]], minlength=len(vocabulary))[of_word], len(index)) for i in present])
        share = (used + 0.02) / (used.sum(1, keepdims=True) + 1)
        share /= share.sum(0)
        factor = SHARED + 1 + (share * np.log(share)).sum(0) / np.log(max(len(present), 2))
    weigh(factor)
    idf = idf * factor
    centroids, of, usual = [], [], []
    for i in present:
        own = good & (label == i)
        if not own.any():
            continue
        have = [centroid(own)]
        for _ in range(CENTROIDS - 1):  # then new ones where those before are far
            s = scores(np.stack(have), own).max(1)
            far = own & (s <= np.quantile(s[own], 0.03))
            have.append(centroid(far))
            for _ in range(3):
                nearest = scores(np.stack(have), own).argmax(1)
                have = [centroid(own & (nearest == j)) if (own & (nearest == j)).any() else have[j] for j in range(len(have))]
        usual.append(np.median(scores(np.stack(have), own).max(1)[own]))
        centroids += have
        of += [i] * len(have)
    # Those that more cues of another language's files are nearest to, for its size, hold foreign passages.
    near, of = scores(np.stack(centroids)), np.array(of)
    size = np.maximum(np.bincount(label[spoken], minlength=len(CODES)), 1)
    taken = near.argmax(1)
    rates = np.stack([np.bincount(label[spoken & (taken == j)], minlength=len(CODES)) / size for j in range(len(of))])
    right = rates[np.arange(len(of)), of] >= rates.max(1)
    right |= ~np.isin(of, of[right])  # a language keeps what it has
    near, of, centroids = near[:, right], list(of[right]), [c for c, r in zip(centroids, right) if r]
    # At last new ones for cues of trusted files that another language's centroids are as near to.
    for _ in range(REPAIRS):
        by = np.stack([near[:, np.flatnonzero(np.array(of) == i)].max(1) if i in of else np.full(n, -1.0) for i in present], 1)
        own = by[np.arange(n), np.searchsorted(present, label)]
        by[np.arange(n), np.searchsorted(present, label)] = -1
        close = good & (by.max(1) >= own * (1 - MARGIN))
        new = []
        for i in present:
            cues = close & (label == i)
            if cues.sum() >= max(3, REPAIR_SHARE * (good & (label == i)).sum()):
                like = scores(centroid(cues)[None], cues)[:, 0]
                new.append(centroid(cues & (like >= np.quantile(like[cues], 0.6))))
                of.append(i)
        if not new:
            break
        near, centroids = np.concatenate([near, scores(np.stack(new))], 1), centroids + new
    names = {g: j for j, g in enumerate(sorted((g for g, i in index.items() if idf[i] > 0), key=index.__getitem__))}
    columns = np.array([index[g] for g in names])
    return Model(names, idf[columns].astype(np.float32), np.stack(centroids)[:, columns].astype(np.float32), np.array(of), float(np.mean(usual)))


_classifiers: dict[int, Classifier] = {}


def _classify_udf(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        if id(m) not in _classifiers:
            _classifiers.clear()
            _classifiers[id(m)] = Classifier(m)
        classify = _classifiers[id(m)]
        for b in batches:
            for s in range(0, b.num_rows, 256):
                some = b.slice(s, 256)
                out: list[tuple] = []
                labels = some.column(1).to_pylist()
                found = classify([cue_words(t.as_py()) for t in some.column(2)])
                for key, label, (positions, scores, votes) in zip(some.column(0).to_pylist(), labels, found):
                    main, share, foreign = decide(positions, scores, votes, m.usual)
                    if main >= 0:
                        out.append((key, 0, CODES[main], share, label_language(label) != CODES[main]))
                        out += [(key, p, CODES[x], c, True) for p, x, c in foreign]
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.bool_()))],
                        ["doc_id", "cue_pos", "lang", "confidence", "differs"])

    return run


def label_code(label: Column) -> Column:
    """:func:`label_language` as built-in functions."""
    words = F.filter(F.split(F.lower(label), r"[^\p{L}]+"), lambda w: w != "")
    named = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])
    later = F.filter(F.transform(F.filter(F.slice(words, 2, 1_000_000), lambda w: F.length(w) > 3), lambda w: F.try_element_at(named, w)), lambda c: c.isNotNull())
    return F.when(F.size(words) > 0, F.coalesce(F.try_element_at(named, F.get(words, F.lit(0))), F.get(later, F.lit(0))))


def sample(documents: DataFrame, files: int = SAMPLE_FILES) -> list[tuple[str, str]]:
    """(label, text) of ``files`` labelled files of each language at most, those whose ids have the least hashes.

    Each task puts out its own least ones of each language; a language of few files is in the sample with all of them.
    """
    named = documents.where("text is not null").select("lang", "text", label_code(F.col("lang")).alias("code"), F.xxhash64("doc_id").alias("h")).where("code is not null")
    limits = named.select("code", "h").withColumn("r", F.row_number().over(Window.partitionBy("code").orderBy("h"))).where(F.col("r") <= files)
    most = {r.code: r.m for r in limits.groupBy("code").agg(F.max("h").alias("m")).collect()}
    if not most:
        return []
    chosen = reduce(lambda a, b: a | b, [(F.col("code") == c) & (F.col("h") <= m) for c, m in most.items()])
    return [(r.lang, r.text) for r in named.where(chosen).orderBy("h", "text").limit(files * len(most)).collect()]


def languages(documents: DataFrame, model: Model | None = None, files: int = SAMPLE_FILES) -> DataFrame:
    """``doc_id, cue_pos, lang, confidence, differs``: for each file with speech a row with ``cue_pos`` 0 and its main
    language, and a row for each cue mainly in another one.

    documents: ``doc_id, text, lang``. ``cue_pos`` counts the lines with ``-->`` from 1. Sound descriptions and adverts
    are no speech. ``confidence`` is the share of the cues for a file and, for a cue, the cosine of its language in that and
    the runner-up's, or, where its sentences voted for another than the nearest language, the share of their letters. ``differs``: the label names no language or another than the main one; true for cues. Files without
    speech, empty and null texts have no row; equal or null ids stay separate files; other columns are ignored.
    """
    spark = documents.sparkSession
    model = model or fit(sample(documents, files))
    ddl = "doc_id bigint, cue_pos int, lang string, confidence double, differs boolean"
    if model is None:
        return spark.createDataFrame([], ddl)
    shared = spark.sparkContext.broadcast(model)
    rows = spread(documents.select(F.col("doc_id").cast("bigint"), "lang", "text").where("text is not null"))
    return rows.mapInArrow(_classify_udf(shared), ddl)
