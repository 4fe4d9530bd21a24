"""Personal information in free text: found by a linear-chain conditional random field, replaced by placeholders.

The texts of a batch are one array of code points. Tokens (runs of letters, runs of digits, single marks) are
cut out of it by numpy, and described by small numbers (word, shape, ending, known-name kind, the kind of the piece
between spaces, the shape of the number it stands in) at their own place and at places around it within the line.
The model is trained by gradient steps on the likelihood of a small labelled table. Every token of every line is
scored; what the scores alone prove to be outside of any personal information is settled, and the stretches in
between are decoded by Viterbi, which gives the same labels as decoding whole lines. What is marked is trimmed to
the exact extent of its type afterwards.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread
from .pii_examples import CARRIERS, LOOKALIKES, TYPES, labelled_table

LABELS = ("O", *(f"{p}-{t}" for t in TYPES for p in "BI"))
K = len(LABELS)
BATCH = 512  # stretches decoded at once
REACH = 5  # tokens that features look ahead and back
CHUNK = 8192  # tokens scored at once
CONJ = 1 << 13
LEAST = 30.0  # scores further below the best than this count as this far, which keeps all sums within range
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("pii_type", T.StringType()), T.StructField("pii_text", T.StringType())]))

TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
WORDS = re.compile(r"[^\W\d_]+")
STREET_AFTER = frozenset("street st road rd lane ln ave avenue drive dr close blvd boulevard court way square terrace place".split())
STREET_BEFORE = frozenset("rue avenue chemin boulevard impasse allée quai place calle avenida avda plaza paseo camino ronda c am im zum".split())
STREET_ENDS = ("straße", "strasse", "str", "weg", "gasse", "allee", "platz", "ring", "ufer")
STREET_END = re.compile(rf"(?:{'|'.join(STREET_ENDS)})$")
NUMBER_RUN = re.compile(r"[+(]*(?:[A-Z]{1,3}[ -]?)?\d(?:[\d ().\-/]*[\d])?(?:[.\-]?[A-Z]\b(?: \d{3}\b)?| [A-Z]\b(?: \d{3}\b)?)?")
PIECE = re.compile(r"\S+")
TITLES = frozenset("dr mr mrs ms miss prof professor herr frau don doña señor señora sr sra m mme mlle monsieur madame author owner colleague kollege kollegin collègue colega compañero compañera".split())
#: Parts of a name before or behind what was marked: joined by a hyphen or apostrophe, or a particle.
JOINED_BEFORE = re.compile(r"(?:(?<![^\W_])[^\W\d_]{1,30}['’\-]|(?:(?<![^\W_])(?:van|von|van der) )|(?:^|(?<=[;'\"—:] )|(?<=[;'\"—:]))(?:de|di|da|del|la|le) )$")
JOINED_AFTER = re.compile(r"(?:['’\-][^\W\d_]{2,30})+(?![^\W_])")
ABBREVIATIONS = frozenset("st rd ave blvd dr ln str".split())

_DOT = r"(?:\.|\s?[\[({<]\s?dot\s?[\])}>]\s?|\sdot\s)"
_AT = r"(?:\s?@\s?|\s?[\[({<]\s?at\s?[\])}>]\s?)"
_MAILBOX = r"(?i)(?<![\w+\-])[^\W_][\w+\-]{0,63}(?:{dot}[\w+\-]{1,63}){0,8}{at}[^\W_][\w\-]{0,62}(?:{dot}[^\W\d_][\w\-]{0,62}){1,8}"  # lengths as mail allows them
EMAIL = tuple(re.compile(_MAILBOX.replace("{dot}", dot).replace("{at}", at)) for dot, at in ((_DOT, _AT), (_DOT, r"\sat\s")))
PHONE = re.compile(r"(?:\+\d{1,3}[ .\-]?|\b1 )?(?:\(\d{1,5}\) ?)?\d(?:[ .\-/]?\d)*")


# ---------------------------------------------------------------------------------- description of tokens
MARKS = "@.,;:'’\"-+/()[]<>{}|=_#&!?`$*%~\\—"
SHAPES = 64
_PIECES = (
    (1, re.compile(r".*git@")),
    (2, re.compile(r".*[\w]@\d")),
    (3, re.compile(r"[^@]*https?://")),
    (4, re.compile(r"[<(\"']*(?:mailto:)?[\w.+\-]+@[\w\-]+(?:\.[\w\-]+)*\.[^\W\d_]{2,}[>)\"'.,;!?]*$")),
    (5, re.compile(r"@\w")),
    (6, re.compile(r".*\w@\W*$")),
    (7, re.compile(r".*@")),
    (8, re.compile(r".*(?:(?<!Ma)(?<!M)[a-z][A-Z]|_|`)")),
)


def _piece(text: str) -> int:
    for code, pattern in _PIECES:
        if pattern.match(text):
            return code
    return 0


class CodePoints:
    """Class, small letter and case of code points, looked up once each."""

    SPACE, LETTER, DIGIT, MARK = range(4)

    def __init__(self) -> None:
        self.kind = np.full(0x110000, 255, np.uint8)
        self.small = np.arange(0x110000, dtype=np.uint32)
        self.case = np.zeros(0x110000, np.int8)  # 1 small, 2 capital
        self.mark = np.full(0x110000, 60, np.int16)
        self.mark[[ord(c) for c in MARKS]] = 19 + np.arange(len(MARKS))
        self.learn(np.arange(0x250))

    def learn(self, codes: np.ndarray) -> None:
        for c in codes.tolist():
            ch = chr(c)
            word = ch.isalnum()
            self.kind[c] = self.SPACE if ch.isspace() else self.DIGIT if ch.isdecimal() else self.LETTER if word else self.MARK
            low = ch.lower()
            self.small[c] = ord(low) if len(low) == 1 else c
            self.case[c] = 2 if ch.isupper() else 1 if ch.islower() else 0

    def kinds(self, codes: np.ndarray) -> np.ndarray:
        out = self.kind[codes]
        if (out == 255).any():
            self.learn(np.unique(codes[out == 255]))
            out = self.kind[codes]
        return out


@lru_cache(maxsize=1)
def code_points() -> CodePoints:
    return CodePoints()


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


STEP = np.uint64(0x9E3779B97F4A7C15)


def _hashes(small: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches of code points."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = (ends - starts).astype(np.int64)
    inside = np.repeat(np.arange(len(starts)), lengths)
    where = np.arange(len(inside)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)
    place = (where - starts[inside]).astype(np.uint64)
    x = (small[where].astype(np.uint64) + np.uint64(1)) * (STEP * (np.uint64(2) * place + np.uint64(3)))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return np.add.reduceat(x, np.cumsum(lengths) - lengths)


def word_hash(word: str) -> int:
    codes = _points(word)
    code_points().kinds(codes)
    small = code_points().small[codes]
    return int(_hashes(small, np.array([0]), np.array([len(small)]))[0])


class Lookup:
    """Numbers of words by their hash, 0 for all others."""

    def __init__(self, numbers: dict[str, int]) -> None:
        pairs = sorted({word_hash(w): n for w, n in numbers.items() if w}.items())
        self.keys = np.array([k for k, _ in pairs], np.uint64)
        self.numbers = np.array([n for _, n in pairs] + [0], np.int32)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, hashes)
        hit = at < len(self.keys)
        hit[hit] = self.keys[at[hit]] == hashes[hit]
        return np.where(hit, self.numbers[np.where(hit, at, -1)], 0)


FIELDS = ("word", "shape", "ending", "name", "street", "piece", "run", "form", "gap")
#: Places at which each field is looked at.
AROUND = (
    *(("word", o) for o in range(-5, 6)),
    *(("shape", o) for o in range(-3, 4)),
    *(("ending", o) for o in (-1, 0, 1)),
    *(("name", o) for o in range(-3, 4)),
    *(("street", o) for o in range(-5, 6)),
    *(("piece", o) for o in (-1, 0, 1)),
    *(("run", o) for o in (-1, 0, 1)),
    *(("form", o) for o in (-1, 0, 1)),
    *(("gap", o) for o in (0, 1, 2)),
)
PAIRED = (
    (("shape", -1), ("shape", 0), ("shape", 1)),
    (("name", -1), ("name", 0), ("gap", 0)),
    (("name", 0), ("name", 1), ("gap", 1)),
    (("name", 0), ("name", 2), ("shape", 1)),
    (("run", 0), ("word", -2), ("word", -1)),
    (("form", 0), ("word", -2), ("word", -1)),
    (("form", 0), ("word", -3), ("shape", -1)),
    (("word", -1), ("name", 0), ("name", 1)),
    (("word", 1), ("name", 0), ("name", -1)),
    (("street", 1), ("street", 2), ("shape", 0)),
    (("gap", 0), ("name", 0), ("gap", 2)),
)


FORMS = 512
_FIGURES = str.maketrans({**{str(d): "9" for d in range(10)}, **{chr(c): "A" for c in range(65, 91)}})


def _run_shape(text: str) -> str:
    return (text.lstrip("(") if text.count("(") > text.count(")") else text).translate(_FIGURES)


def _run_form(shape: str) -> int:
    """Digits, kinds of separators, letters before and behind: what numbers of unknown shape have in common."""
    digits = min(shape.count("9"), 17)
    seps = sum(1 << i for i, c in enumerate("-. /") if c in shape)
    letters = (1 if shape[:1] == "A" else 0) + (2 if shape[-1:] == "A" else 0)
    lead = 2 if shape[:1] == "+" else 1 if "(" in shape else 0
    return 2 + ((digits * 16 + seps) * 4 + letters + 2309 * lead) % (FORMS - 2)


class Vocabulary:
    def __init__(self, words: list[str], endings: list[str], runs: list[str], given: frozenset[str], family: frozenset[str]) -> None:
        self.given, self.family = given, family
        self.unknown = len(words) + 1
        self.n_endings = len(endings)
        self.runs = {r: i for i, r in enumerate(runs)}
        self.word = Lookup({w: i + 1 for i, w in enumerate(words)})
        self.ending = Lookup({e: i + 2 for i, e in enumerate(endings)})
        self.known = Lookup({w: (2 if w in family else 0) + (1 if w in given else 0) for w in given | family})
        self.street = Lookup({**{w: 2 for w in STREET_AFTER}, **{w: 3 for w in STREET_BEFORE}, **{w: 5 for w in STREET_AFTER & STREET_BEFORE}})

    def sizes(self) -> dict[str, int]:
        return {"word": self.unknown + 7, "shape": SHAPES, "ending": self.n_endings + 2, "name": 4 * 6 + 2, "street": 6, "piece": 10, "run": 3 * (len(self.runs) + 2) + 2, "form": FORMS, "gap": 5}


@dataclass
class Tokens:
    """Tokens of a batch of texts: places in the joined text, fields (FIELDS, tokens), and the line each stands in."""

    start: np.ndarray
    end: np.ndarray
    fields: np.ndarray
    line: np.ndarray


def tokens_of(text: str) -> tuple[np.ndarray, ...]:
    """Starts, ends, kinds and lines of the tokens of a text of several lines, with its small code points."""
    points = code_points()
    codes = _points(text)
    kind = points.kinds(codes)
    line_at = np.cumsum(codes == 10)
    edge = np.ones(len(codes), bool)
    edge[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == CodePoints.MARK)
    start = np.flatnonzero(edge & (kind != CodePoints.SPACE))
    bound = np.append(np.flatnonzero(edge), len(codes))
    end = bound[np.searchsorted(bound, start, "right")]
    return start, end, kind[start], line_at[start], points.small[codes], codes


def described(text: str, voc: Vocabulary) -> Tokens:
    """The tokens of a text of several lines and their fields. 0 stands for nothing there."""
    points = code_points()
    start, end, kind, line, small, codes = tokens_of(text)
    n = len(start)
    if not n:
        return Tokens(start, end, np.zeros((len(FIELDS), 0), np.int32), line)
    length = end - start
    letters, digits = kind == CodePoints.LETTER, kind == CodePoints.DIGIT
    hashes = _hashes(small, start, end)
    case = points.case[codes]
    before = lambda flag: np.append(0, np.cumsum(flag))
    caps, smalls = before(case == 2), before(case == 1)
    n_caps, n_small = caps[end] - caps[start], smalls[end] - smalls[start]
    first_cap = case[start] == 2
    shape = points.mark[codes[start]].astype(np.int32)
    shape[digits] = np.minimum(length[digits], 12)
    title = first_cap & (n_caps == 1) & (n_small > 0)
    worded = np.where(length == 1, np.where(n_caps > 0, 13, 14), np.where((n_caps > 0) & (n_small == 0), 15, np.where((n_small > 0) & (n_caps == 0), 16, np.where(title, 17, 18))))
    shape = np.where(letters, worded, shape)
    word = voc.word(hashes)
    word = np.where(word > 0, word, np.where(digits, voc.unknown + np.minimum(length, 5), np.where(letters, voc.unknown, voc.unknown + 6)))
    ending = np.ones(n, np.int32)
    long = np.flatnonzero(letters & (length > 3))
    ending[long] = np.maximum(voc.ending(_hashes(small, end[long] - 3, end[long])), 1)
    name = np.full(n, 25, np.int32)
    own = np.flatnonzero(letters)
    name[own] = 1 + voc.known(hashes[own]) * 6 + (shape[own] - 13)
    street = np.where(letters, 1, 0)
    for suffix in STREET_ENDS:
        ended = own[length[own] >= len(suffix)]
        for back, ch in enumerate(reversed(suffix), 1):
            ended = ended[small[end[ended] - back] == ord(ch)]
        street[ended] = 4
    street[own] = np.where((found := voc.street(hashes[own])) > 0, found, street[own])
    # pieces between spaces
    space = np.append(True, points.kind[codes] == CodePoints.SPACE)
    piece_start = np.flatnonzero(space[:-1] & ~space[1:])
    piece_end = np.append(np.flatnonzero(~space[1:-1] & space[2:]) + 1, len(codes))[: len(piece_start)] if len(codes) > 1 else np.array([len(codes)])
    odd = (codes == 64) | (codes == 95) | (codes == 96)
    odd[1:] |= (case[1:] == 2) & (case[:-1] == 1)
    odd[:-2] |= (codes[:-2] == 58) & (codes[1:-1] == 47) & (codes[2:] == 47)
    odds = before(odd)
    code = np.zeros(len(piece_start), np.int32)
    for k in np.flatnonzero(odds[piece_end] > odds[piece_start]).tolist():
        code[k] = _piece(text[piece_start[k] : piece_end[k]])
    piece = 1 + code[np.searchsorted(piece_start, start, "right") - 1]
    # numbers
    run, form = np.ones(n, np.int32), np.ones(n, np.int32)
    marks = [(m.start(), m.end(), _run_shape(m[0])) for m in NUMBER_RUN.finditer(text)]
    if marks:
        a = np.array([m[0] for m in marks])
        b = np.array([m[1] for m in marks])
        which = np.array([voc.runs.get(m[2], len(voc.runs) + 1) for m in marks])
        forms = np.array([_run_form(m[2]) for m in marks])
        at = np.searchsorted(a, start, "right") - 1
        hit = (at >= 0) & (start < b[at])
        at = at[hit]
        run[hit] = 2 + 3 * which[at] + np.where(start[hit] == a[at], 0, np.where(end[hit] == b[at], 2, 1))
        form[hit] = forms[at]
    gap = np.full(n, 3, np.int32)
    gap[1:][start[1:] == end[:-1]] = 2
    gap[np.append(True, line[1:] != line[:-1])] = 1
    fields = np.stack([word, np.minimum(1 + shape, SHAPES - 1), ending, name, street, piece, run, form, gap]).astype(np.int32)
    return Tokens(start, end, fields, line)


def vocabulary(table: list, given: set[str], family: set[str]) -> Vocabulary:
    literal = " ".join(re.sub(r"\{[A-Za-z_]+\}", " ", c) for c in CARRIERS + LOOKALIKES)
    words = sorted({m[0].lower() for m in TOKEN.finditer(literal)} | {"at", "dot", "example", "test", "org", "net", "com", "mail", "de", "van", "von", "d", "o", "al", "la", "del", "der", "bis", "ter", "nº", "n"} | set("@.,;:'\"-+/()[]<>{}|=_#"))
    ends, runs = {}, {}
    for text, _ in table:
        for w in WORDS.findall(text):
            if len(w) > 3:
                ends[w.lower()[-3:]] = ends.get(w.lower()[-3:], 0) + 1
        for m in NUMBER_RUN.finditer(text):
            runs[_run_shape(m[0])] = runs.get(_run_shape(m[0]), 0) + 1
    split = lambda parts: frozenset(w.lower() for p in parts for w in WORDS.findall(p) if len(w) > 2)
    return Vocabulary(words, sorted(e for e, n in ends.items() if n >= 4), sorted(e for e, n in runs.items() if n >= 3), split(given), split(family))


# ---------------------------------------------------------------------------------- the model
def _apart_lines(tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Fields with REACH empty places before each line and at the end, and the place of every token in them."""
    new = np.append(True, tokens.line[1:] != tokens.line[:-1]) if len(tokens.line) else np.zeros(0, bool)
    at = np.arange(len(tokens.line)) + REACH * np.cumsum(new)
    out = np.zeros((len(FIELDS), (at[-1] if len(at) else 0) + 1 + REACH), np.int32)
    out[:, at] = tokens.fields
    return out, at


def _columns(wide: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Feature numbers of the tokens at these places, one array per feature table."""
    place = {f: wide[i] for i, f in enumerate(FIELDS)}
    own = {k: place[k[0]][at + k[1]] for k in {*AROUND, *(k for parts in PAIRED for k in parts)}}
    out = [own[k] for k in AROUND]
    for parts in PAIRED:
        mixed = np.zeros(len(at), np.int64)
        for k in parts:
            mixed = mixed * 1009 + own[k]
        out.append((mixed % CONJ).astype(np.int32))
    return out


def _allowed() -> np.ndarray:
    ok = np.ones((K, K), bool)
    for j, name in enumerate(LABELS):
        if name[0] == "I":
            ok[:, j] = [LABELS[i][1:] == name[1:] and LABELS[i] != "O" for i in range(K)]
    return ok


ALLOWED = _allowed()
STARTS = np.array([n[0] != "I" for n in LABELS])


def _best_around(gain: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Greatest sum over the stretches of consecutive tokens of a line that hold the token."""
    line = np.cumsum(np.append(0, last[:-1]))
    wall = float(np.maximum(gain, 0.0).sum()) + 1.0  # so that no sum reaches over the end of a line

    def upto(g: np.ndarray, line: np.ndarray) -> np.ndarray:
        total = np.cumsum(g) - wall * line
        low = np.minimum.accumulate(total - g)  # sums before the token, lower on each new line
        return total - low

    return upto(gain, line) + upto(gain[::-1], (line[-1] - line)[::-1])[::-1] - gain if len(gain) else gain


def _add_up(out: np.ndarray, tables: list[np.ndarray], columns: list[np.ndarray]) -> None:
    own = np.empty_like(out)
    for table, column in zip(tables, columns):
        np.take(table, column, axis=0, out=own, mode="clip")
        out += own


@dataclass
class Model:
    voc: Vocabulary
    tables: list[np.ndarray]
    moves: np.ndarray

    def scores(self, tokens: Tokens) -> np.ndarray:
        wide, at = _apart_lines(tokens)
        out = np.zeros((len(at), K), np.float32)
        for first in range(0, len(at), CHUNK):
            _add_up(out[first : first + CHUNK], self.tables, _columns(wide, at[first : first + CHUNK]))
        return out

    def viterbi(self, score: np.ndarray, lengths: np.ndarray, before_outside: np.ndarray) -> np.ndarray:
        """Best label sequences of stretches padded to one length; those so marked end before a token outside."""
        n, size, _ = score.shape
        moves = np.where(ALLOWED, self.moves, -1e9).astype(np.float32)
        best = np.where(STARTS, score[:, 0], -1e9)
        back = np.zeros((n, size, K), np.int8)
        bests = np.empty((n, size, K), np.float32)
        bests[:, 0] = best
        for t in range(1, size):
            step = best[:, :, None] + moves
            back[:, t] = step.argmax(1)
            best = step.max(1) + score[:, t]
            bests[:, t] = best
        out = np.zeros((n, size), np.int8)
        rows = np.arange(n)
        state = np.zeros(n, np.int64)
        leave = np.where(before_outside[:, None], moves[:, 0], 0.0)
        for t in range(size - 1, -1, -1):
            state = np.where(lengths - 1 == t, (bests[rows, t] + leave).argmax(1), state)
            out[:, t] = state
            state = np.where(lengths > t, back[rows, t, state], state)
        return out

    def outside(self, score: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Tokens that the best sequence surely leaves unmarked; ``last`` tells the last tokens of lines.

        Against leaving it unmarked, a marked stretch can gain at most the sum over its tokens of the best label's
        score above that of no label, once every label is credited with the most a move to it can bring. The
        greatest such sum of all stretches around a token comes from running sums in both directions; where it is
        negative no best sequence marks the token.
        """
        moves = np.where(ALLOWED, self.moves - self.moves[0, 0], -np.inf).astype(np.float64)
        paid = -np.maximum(moves[:, 0], 0.0)  # what leaving a label brings is credited to the label
        paid[0] = 0.0
        credit = np.maximum((moves + paid[:, None]).max(0), np.where(STARTS, 0.0, -np.inf)) - paid
        gain = (score[:, 1:] + credit[1:]).max(1).astype(np.float64) - score[:, 0]
        return _best_around(gain, last) < -1e-3

    def labels(self, tokens: Tokens) -> np.ndarray:
        """Best label of every token, lines being sequences."""
        n = len(tokens.start)
        out = np.zeros(n, np.int8)
        if not n:
            return out
        score = self.scores(tokens)
        last = np.append(tokens.line[1:] != tokens.line[:-1], True)
        open_ = ~self.outside(score, last)
        before = np.append(False, open_[:-1] & ~last[:-1])
        begin = np.flatnonzero(open_ & ~before)
        stop = np.flatnonzero(open_ & ~np.append(open_[1:] & ~last[:-1], False)) + 1
        at_start = np.append(True, last[:-1])[begin]  # of a line, else behind a token outside
        lengths = stop - begin
        order = np.argsort(lengths, kind="stable")
        for first in range(0, len(order), BATCH):
            own = order[first : first + BATCH]
            size = int(lengths[own].max())
            at = begin[own][:, None] + np.minimum(np.arange(size), lengths[own][:, None] - 1)
            x = score[at]
            x[:, 0] += np.where(at_start[own][:, None], 0.0, self.moves[0])
            best = self.viterbi(x, lengths[own], ~last[stop[own] - 1])
            live = np.arange(size) < lengths[own][:, None]
            out[at[live]] = best[live]
        return out


class _Part:
    """A part of the labelled lines: feature numbers, labels, and the tokens of all lines at each place."""

    def __init__(self, columns: list[np.ndarray], marks: np.ndarray, firsts: np.ndarray, lengths: np.ndarray) -> None:
        order = np.argsort(-lengths, kind="stable")
        firsts, lengths = firsts[order], lengths[order]
        begins = np.cumsum(lengths) - lengths
        own = np.repeat(firsts - begins, lengths) + np.arange(lengths.sum())
        self.columns, self.marks, self.n = [c[own] for c in columns], marks[own], len(own)
        self.at = [begins[: int((lengths > t).sum())] + t for t in range(int(lengths.max()))]
        self.orders = [np.argsort(c, kind="stable") for c in self.columns]
        self.starts = [np.flatnonzero(np.append(True, np.diff(c[o]) > 0)) for c, o in zip(self.columns, self.orders)]
        self.keys = [c[o][s] for c, o, s in zip(self.columns, self.orders, self.starts)]
        self.seen = np.zeros((K, K))
        for before, after in zip(self.at, self.at[1:]):
            np.add.at(self.seen, (self.marks[before[: len(after)]], self.marks[after]), 1)

    def surplus(self, model: Model) -> tuple[np.ndarray, np.ndarray]:
        """Expected less observed labels of all tokens and moves, by the forward and backward sums of the chain."""
        total = np.zeros((self.n, K), np.float32)
        for first in range(0, self.n, CHUNK):
            _add_up(total[first : first + CHUNK], model.tables, [c[first : first + CHUNK] for c in self.columns])
        score = np.exp(np.maximum(total - total.max(1, keepdims=True), -LEAST).astype(np.float64))
        move = np.where(ALLOWED, np.exp(np.clip(model.moves, -LEAST, LEAST)), 0.0)
        forward, backward, scale = np.empty_like(score), np.ones_like(score), np.empty(self.n)
        for t, at in enumerate(self.at):
            a = (forward[self.at[t - 1][: len(at)]] @ move if t else STARTS) * score[at]
            scale[at] = np.maximum(a.sum(1), 1e-200)
            forward[at] = a / scale[at][:, None]
        expected = np.zeros((K, K))
        for t in range(len(self.at) - 1, 0, -1):
            at = self.at[t]
            before = self.at[t - 1][: len(at)]
            right = score[at] * backward[at] / scale[at][:, None]
            expected += (forward[before].T @ right) * move
            backward[before] = right @ move.T
        posterior = forward * backward
        posterior /= np.maximum(posterior.sum(1, keepdims=True), 1e-200)
        posterior[np.arange(self.n), self.marks] -= 1
        return posterior.astype(np.float32), expected - self.seen


def train(known: dict[str, list[str]], rounds: int = 8, steps: int = 240, parts: int = 4, rate: float = 0.05, decay: float = 5e-3) -> Model:
    """Fit the model to the labelled table by gradient steps of adapted and shrinking width over its parts in turn."""
    table = labelled_table(known, rounds)
    voc = vocabulary(table, set(known.get("given", [])), set(known.get("family", [])))
    tokens = described("\n".join(text for text, _ in table), voc)
    begins = np.cumsum([0] + [len(text) + 1 for text, _ in table])
    marks = np.zeros(len(tokens.start), np.int64)
    for a, b, kind in [(begins[i] + a, begins[i] + b, kind) for i, (_, truth) in enumerate(table) for a, b, kind in truth]:
        lo, hi = np.searchsorted(tokens.start, [a, b])
        marks[lo] = LABELS.index("B-" + kind)
        marks[lo + 1 : hi] = LABELS.index("I-" + kind)
    columns = _columns(*_apart_lines(tokens))
    _, firsts, lengths = np.unique(tokens.line, return_index=True, return_counts=True)
    share = np.random.default_rng(3).permutation(len(firsts)) % parts
    own = [_Part(columns, marks, firsts[share == k], lengths[share == k]) for k in range(parts)]
    sizes = voc.sizes()
    heights = [sizes[f] for f, _ in AROUND] + [CONJ] * len(PAIRED)
    model = Model(voc, [np.zeros((h, K), np.float32) for h in heights], np.zeros((K, K), np.float32))
    params = [*model.tables, model.moves]
    mean = [np.zeros_like(p) for p in params]
    square = [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        part = own[step % parts]
        diff, moves = part.surplus(model)
        grads = []
        for p, o, s, keys in zip(model.tables, part.orders, part.starts, part.keys):
            g = decay * p
            g[keys] += np.add.reduceat(diff[o], s, axis=0)
            grads.append(g)
        grads.append((moves + decay * model.moves).astype(np.float32))
        width = rate * (1 - 0.9 * step / steps)
        for p, g, m, v in zip(params, grads, mean, square):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= width * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-3)
    if not all(np.isfinite(p).all() for p in params):
        raise RuntimeError("the training did not stay finite")
    return model


@lru_cache(maxsize=2)
def trained(given: tuple[str, ...], family: tuple[str, ...]) -> Model:
    """The model for these known name parts, trained once per driver."""
    return train({"given": list(given), "family": list(family)})


# ---------------------------------------------------------------------------------- from labels to spans
def _trimmed(line: str, a: int, b: int, kind: str, given: frozenset[str] = frozenset()) -> tuple[int, int] | None:
    """The exact extent of a marked stretch, or None if it can't be of its type."""
    if kind == "email":
        for form in EMAIL:
            for m in form.finditer(line, max(0, a - 40), min(len(line), b + 40)):
                if m.start() < b and m.end() > a:
                    return m.span()
        return None
    if kind == "phone":
        for m in PHONE.finditer(line, max(0, a - 4)):
            if m.start() >= b:
                return None
            if m.end() > a and 7 <= sum(c.isdigit() for c in m[0]) <= 15:
                return m.span()
        return None
    strip = " .,;:!?'\"`|<>()[]{}—-="
    while b > a and line[b - 1] in strip:
        b -= 1
    while a < b and line[a] in strip:
        a += 1
    text = line[a:b]
    if kind == "id_number":
        return (a, b) if sum(c.isdigit() for c in text) >= 5 else None
    if kind == "street_address":
        words = WORDS.findall(text)
        if not words or not any(c.isdigit() for c in text):
            return None
        if not any(w.lower() in STREET_AFTER or w.lower() in STREET_BEFORE or STREET_END.search(w.lower()) for w in words):
            return None
        if b < len(line) and line[b] == "." and text.rsplit(" ", 1)[-1].lower() in ABBREVIATIONS - {"ave", "blvd", "dr"}:
            b += 1
        return a, b
    while (m := re.match(r"([^\W\d_]+)\.? +", line[a:b])) and m[1].lower() in TITLES:
        a += m.end()
    near = max(0, a - 60)
    before = re.search(r"(?:^|(?<=\s))([^\W\d_a-z][^\W\d_]+) $", line[near:a])
    if before and re.match(r"[^\W\d_]\. ", line[a:b]) and (before[1].lower() in given or (near + before.start() == 0 and not line[b:].strip())):
        a = near + before.start()
    if m := JOINED_BEFORE.search(line, max(0, a - 40), a):
        a = m.start()
    if m := JOINED_AFTER.match(line, b, min(len(line), b + 40)):
        b = m.end()
    text = line[a:b]
    words = WORDS.findall(text)
    if any(c.isdigit() for c in text) or sum(len(w) > 1 for w in words) < 1 or len(re.split(r"[ ,]+", text)) < 2:
        return None
    if b < len(line) and line[b] == "." and re.search(r"(?:^|[ ,])[^\W\d_]$", text):
        b += 1
    if len([w for w in re.split(r"[ ,]+", text) if len(w.strip(".")) > 1]) < (1 if re.match(r"[^\W\d_]\.", text) else 2):
        return None
    return a, b


def find_spans(texts: list[str | None], model: Model) -> list[list[tuple[int, int, str, str]]]:
    """``(start, end, type, text)`` of all personal information of each text, in order of place."""
    found: list[list] = [[] for _ in texts]
    whole = "\n".join(t or "" for t in texts)
    begins = np.cumsum([0] + [len(t or "") + 1 for t in texts])
    tokens = described(whole, model.voc)
    labels = model.labels(tokens)
    for a, b, kind in _stretches(labels, tokens):
        low, high = whole.rfind("\n", 0, a) + 1, whole.find("\n", b)
        line = whole[low : high if high >= 0 else len(whole)]
        if extent := _trimmed(line, a - low, b - low, kind, model.voc.given):
            i = int(np.searchsorted(begins, low, "right")) - 1
            s, e = extent
            found[i].append((int(low + s - begins[i]), int(low + e - begins[i]), kind, line[s:e]))
    return [_apart(sorted(set(spans))) for spans in found]


def _stretches(labels: np.ndarray, tokens: Tokens) -> list[tuple[int, int, str]]:
    """``(start, end, type)`` of what is marked; a label that continues nothing begins a stretch of its own."""
    at = np.flatnonzero(labels)
    out: list = []
    for k, label, a, b, line in zip(at.tolist(), labels[at].tolist(), tokens.start[at].tolist(), tokens.end[at].tolist(), tokens.line[at].tolist()):
        name = LABELS[label]
        if name[0] == "I" and out and out[-1][3] == k - 1 and out[-1][4] == line and out[-1][2] == name[2:]:
            out[-1][1], out[-1][3] = b, k
        else:
            out.append([a, b, name[2:], k, line])
    return [(a, b, kind) for a, b, kind, _, _ in out]


def _apart(spans: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Of spans that overlap the longest stays."""
    out: list = []
    for span in spans:
        if out and span[0] < out[-1][1]:
            if span[1] - span[0] > out[-1][1] - out[-1][0]:
                out[-1] = span
        else:
            out.append(span)
    return out


def known_names(name_parts: DataFrame) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Known given and family parts, a table of fixed size."""
    rows = name_parts.where("name_part is not null").select("name_part", "part_kind").distinct().collect()
    return tuple(tuple(sorted(r["name_part"] for r in rows if r["part_kind"] == kind)) for kind in ("given", "family"))


def pii_spans(text: Column, model: Model) -> Column:
    """Array of ``start, end, pii_type, pii_text`` (code points) of each whole text; empty for null and empty texts."""

    @F.pandas_udf(SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        found = []
        for first in range(0, len(texts), 500):  # bounds what one decoding holds
            found += find_spans(list(texts.iloc[first : first + 500]), model)
        return pd.Series([[{"start": a, "end": b, "pii_type": k, "pii_text": t} for a, b, k, t in row] for row in found])

    return spans.asNondeterministic()(text)  # else a filter on the result would run it a second time


def with_pii(documents: DataFrame, name_parts: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with ``pii``, the spans of their texts, in a column that replaces any of that name."""
    model = trained(*known_names(name_parts))
    return spread(documents).withColumn("pii", pii_spans(F.col(text), model))


def redacted(text: Column, pii: Column) -> Column:
    """The text with a placeholder such as ``[EMAIL]`` in the stead of every span; null stays null."""
    state = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    step = lambda acc, s: F.struct(
        F.concat(acc["done"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["pii_type"]), F.lit("]")).alias("done"), s["end"].alias("at")
    )
    return F.aggregate(pii, state, step, lambda acc: F.concat(acc["done"], F.substr(text, acc["at"] + 1, F.length(text))))
