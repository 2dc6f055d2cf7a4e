"""Secret scans by grammar inference.

Labelled credentials build a prefix tree; states whose futures are
statistically compatible (Hoeffding bound on every outgoing and final frequency,
checked recursively) are merged in the red-blue order into a probabilistic
automaton. Every candidate string of the corpus is scored by the automaton: its
log likelihood against that under a chain fitted to unlabelled runs decides
whether it has the format of a credential.

Labels come from assignment, access-key and hex patterns in the corpus itself
(``base`` findings: always reported) plus strings made by rule for well-known key
formats. Candidates are the maximal runs of at least 8 characters
``[A-Za-z0-9+/_.=-]``, dots at their end left aside, and the parts of such a run
between ``=`` and ``/``, so that a key glued to a name or a path is seen too.
Strings are read as symbols: decimal digits, the letters a-f, g-z, A-F, G-Z, and
every other character as itself.

Both models are fitted to all distinct strings: the automaton to every labelled
one, the chain to every unlabelled run. For the threshold the runs are dealt into two
folds by their hashes and each is scored by a chain fitted to the other one; a part,
which can be of runs of both, gets the higher of its two scores. It is ``threshold``
bits, or more where more than one in ``FALSE_OF`` runs, or of all that is scored (the
runs and their parts), would reach it.

At scale: a map over the texts leaves labelled strings, runs and parts, a shuffle makes
them distinct, and maps over those count the chain's pairs and score the folds. What
the driver gets are the distinct labelled strings as symbols, with their numbers, and
one table of counts; merging moves them through the automaton in arrays, a byte a
symbol. The last map scores the distinct candidates of whole Arrow batches, all strings
together one character at a time. Only texts that contain a keyword, an access-key
prefix or a long run are looked at by patterns.

Edge cases: null and empty texts have no findings; very long texts and runs are
read whole; overlapping findings of different kinds are all listed; an added span
that lies inside a base span or another added span is not listed again; ties at the
threshold are findings; without labels or runs in the corpus the rule-made strings
alone train the models; an empty table gives no rows; repeated documents are each
reported; extra columns are kept by ``redact`` and ignored by ``secret_scan``,
whatever their names.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, raw, scratch, stored, texts_of

ALPHA = 0.01
MIN_RUN, MIN_HEX = 8, 32
THRESHOLD = 16.0
FALSE_OF = 1000
MASK = "[SECRET]"
KINDS = ("assign", "access", "hex", "format")
PART, RUN, LABEL = range(3)
"""What a distinct string is; the greatest of what it is anywhere."""
ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

# The symbols that strings are read as, and public formats of keys (c alphanumeric, C upper case or digit, d digit, h hex digit).
SYMBOLS = "dhlHL+/_.=-"
FORMATS = {
    "access": "AKIA" + "C" * 16,
    "github": "ghp_" + "c" * 36,
    "gitlab": "glpat-" + "c" * 20,
    "google": "AIza" + "c" * 35,
    "slack": "xoxb-" + "d" * 12 + "-" + "d" * 12 + "-" + "c" * 24,
    "stripe": "sk_live_" + "c" * 24,
    "npm": "npm_" + "c" * 36,
    "password": "c" * 12,
    "secret": "c" * 40,
    "hex32": "h" * 32,
    "hex40": "h" * 40,
    "hex64": "h" * 64,
}
_PREFIX = re.compile(r"AKIA|ghp_|glpat-|AIza|xoxb-|sk_live_|npm_")

_SYMBOL = {c: "d" for c in string.digits} | {c: "h" if c <= "f" else "l" for c in string.ascii_lowercase} | {c: "H" if c <= "F" else "L" for c in string.ascii_uppercase}
_CODE = np.full(256, -1, np.int8)
for _c in string.ascii_letters + string.digits + "+/_.=-":
    _CODE[ord(_c)] = SYMBOLS.index(_SYMBOL.get(_c, _c))
_RUN = _CODE >= 0
_AS_SYMBOL = np.full(256, len(SYMBOLS), np.int8)  # of strings of symbols; every other byte ends one
for _k, _c in enumerate(SYMBOLS):
    _AS_SYMBOL[ord(_c)] = _k
SHAPE = (2, (len(SYMBOLS) + 1) ** 2, len(SYMBOLS))
"""Pair counts of two folds: by the two symbols before, then by symbol."""
_PART = _RUN.copy()
_PART[[ord("="), ord("/")]] = False


def symbols(value: str) -> str:
    return "".join(_SYMBOL.get(c, c) for c in value)


def base_findings(text: str) -> list[tuple[int, int, int, int, int]]:
    """(kind, start, end, start of the value, its end) of the base patterns, by start, then kind."""
    out = [(0, *m.span(), *m.span(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(1, *m.span(), *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(2, *m.span(), *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], x[0]))


def long_runs(data: np.ndarray, offsets: np.ndarray, least: int = MIN_RUN, letters: np.ndarray = _RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, start, end) in bytes of the maximal runs of candidate characters, dots at their ends left aside."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = letters[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    long = ends - starts >= least
    starts, ends = starts[long], ends[long]
    for _ in range(3):
        ends = ends - ((data[ends - 1] == ord(".")) & (ends > starts))
    for k in np.flatnonzero((ends > starts) & (data[ends - 1] == ord("."))).tolist():  # more than three dots are rare
        ends[k] = starts[k] + len(data[starts[k] : ends[k]].tobytes().rstrip(b"."))
    long = ends - starts >= least
    starts, ends = starts[long], ends[long]
    return np.searchsorted(offsets, starts, side="right") - 1, starts, ends


def all_base(texts: pa.StringArray) -> list[list[tuple]]:
    """The base findings of each text of a batch."""
    data, offsets = raw(texts)
    lowered = data.tobytes().lower()
    wanted = set(long_runs(data, offsets, MIN_HEX)[0].tolist())
    for word in (*KEYWORDS, b"akia"):
        at = lowered.find(word)
        while at >= 0:
            wanted.add(d := int(np.searchsorted(offsets, at, side="right")) - 1)
            at = lowered.find(word, int(offsets[d + 1]) if d + 1 < len(offsets) else len(lowered))
    return [base_findings(texts[d].as_py()) if d in wanted else [] for d in range(len(texts))]


def own_parts(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: list[list[tuple]]) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) in bytes of the parts of the given runs that are not the whole run, and not inside a base finding."""
    cuts = np.flatnonzero(_RUN[data] & ~_PART[data])
    split = np.searchsorted(cuts, starts) < np.searchsorted(cuts, ends)
    starts, ends = starts[split], ends[split]
    edges = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    moved = starts - edges[:-1]
    run, first, last = long_runs(data[np.arange(edges[-1]) + np.repeat(moved, ends - starts)], edges, letters=_PART)
    first, last = first + moved[run], last + moved[run]
    owner, new = np.searchsorted(offsets, first, side="right") - 1, np.ones(len(first), bool)
    for d in np.unique(owner).tolist():
        if base[d]:
            at = offsets[d] + np.append(np.flatnonzero((data[offsets[d] : offsets[d + 1]] & 0xC0) != 0x80), offsets[d + 1] - offsets[d])
            lo, hi = np.searchsorted(owner, [d, d + 1])
            before = np.searchsorted(at[[x[1] for x in base[d]]], first[lo:hi], side="right")  # base findings that begin no later
            reach = np.maximum.accumulate(at[[x[2] for x in base[d]]])
            new[lo:hi] = (before == 0) | (reach[np.maximum(before, 1) - 1] < last[lo:hi])
    return first[new], last[new]


def strings_of(docs: DataFrame, text: str) -> DataFrame:
    """(value, kind): all distinct labelled strings, candidate runs and further parts of runs; what is labelled anywhere is labelled, what is a run anywhere is a run."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, "text"):
            texts = texts_of(batch.column("text"))
            base = all_base(texts)
            labels = {texts[d].as_py()[x[3] : x[4]].encode() for d, found in enumerate(base) for x in found}
            data, offsets = raw(texts)
            _, *at = long_runs(data, offsets)
            whole = data.tobytes()
            runs, parts = ({whole[a:b] for a, b in zip(x.tolist(), y.tolist(), strict=True)} - labels for x, y in (at, own_parts(data, offsets, *at, base)))
            parts -= runs
            kinds = [LABEL] * len(labels) + [RUN] * len(runs) + [PART] * len(parts)
            yield pa.RecordBatch.from_arrays([pa.array([*labels, *runs, *parts], pa.binary()).cast(pa.string()), pa.array(kinds, pa.int32())], ["value", "kind"])

    found = docs.select(F.col(text).alias("text")).mapInArrow(look, "value string, kind int")
    return found.groupBy("value").agg(F.max("kind").alias("kind"))


def made_by_rule(each: int = 12, seed: int = 7, without: tuple[str, ...] = ()) -> list[str]:
    """Labelled credentials of well-known public formats."""
    pick = random.Random(seed)
    letters = {"c": string.ascii_letters + string.digits, "C": string.ascii_uppercase + string.digits, "d": string.digits, "h": "0123456789abcdef"}
    out = []
    for _ in range(each):
        for name, form in FORMATS.items():
            fixed = m.end() if (m := _PREFIX.match(form)) else 0
            made = form[:fixed] + "".join(pick.choice(letters.get(c, c)) for c in form[fixed:])
            if name not in without:
                out.append(made)
    return out


class Node:
    """A node of the prefix tree of what is left of strings: ``at`` is where each goes on in the data, ``weight`` how many strings it stands for."""

    def __init__(self, data: np.ndarray, at: np.ndarray, weight: np.ndarray):
        self.data, self.at, self.weight = data, at, weight
        self.code = data[at]
        self.count = np.bincount(self.code, weight, len(SYMBOLS) + 1).tolist()
        self.total = sum(self.count)
        self.below: dict[int, Node] = {}

    def child(self, c: int) -> Node | None:
        if c not in self.below and self.count[c]:
            mine = self.code == c
            self.below[c] = Node(self.data, self.at[mine] + 1, self.weight[mine])
        return self.below.get(c)


class Automaton:
    """A probabilistic automaton inferred from strings, or from the numbers of strings by their symbols; end of string is the symbol after the last one.

    Every string rests at the blue state that it has come to; merging or promoting that
    state moves its strings on, all together, until they rest or end.
    """

    def __init__(self, strings: list[str] | Mapping[str, int], alpha: float = ALPHA):
        counts = strings if isinstance(strings, Mapping) else Counter(map(symbols, strings))
        forms = sorted(counts)
        self.data = _AS_SYMBOL[np.frombuffer("".join(f + "\n" for f in forms).encode(), np.uint8)]
        ends = np.cumsum([len(f) + 1 for f in forms], dtype=np.int64)
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.next = np.zeros((0, len(SYMBOLS)), np.int32)
        self.count = np.zeros((0, len(SYMBOLS) + 1))
        self.blue: dict[tuple[int, int], Node] = {}
        self._promote(np.concatenate([[0], ends[:-1]]).astype(np.int64) if forms else ends, np.array([counts[f] for f in forms], np.float64))
        self._merge()
        self._finish()

    def _promote(self, at: np.ndarray, weight: np.ndarray) -> None:
        self.next = np.vstack([self.next, np.full((1, len(SYMBOLS)), -1, np.int32)])
        self.count = np.vstack([self.count, np.zeros((1, len(SYMBOLS) + 1))])
        self._move(len(self.next) - 1, at, weight)

    def _move(self, state: int, at: np.ndarray, weight: np.ndarray) -> None:
        """Adds what is left of the strings to the automaton at ``state``."""
        kinds, rest = len(SYMBOLS), []
        now = np.full(len(at), state, np.int64)
        while len(at):
            code = self.data[at].astype(np.int64)
            self.count += np.bincount(now * (kinds + 1) + code, weight, self.count.size).reshape(self.count.shape)
            more = code < kinds
            now, code, at, weight = now[more], code[more], at[more] + 1, weight[more]
            to = self.next[now, code]
            stay = to < 0
            rest.append((now[stay] * kinds + code[stay], at[stay], weight[stay]))
            now, at, weight = to[~stay].astype(np.int64), at[~stay], weight[~stay]
        if not sum(len(x) for x, _, _ in rest):
            return
        place, at, weight = (np.concatenate(x) for x in zip(*rest, strict=True))
        order = np.argsort(place, kind="stable")
        places, first = np.unique(place[order], return_index=True)
        for k, part in zip(places.tolist(), np.split(order, first[1:]), strict=True):
            old = self.blue.get(key := divmod(k, kinds))
            parts = (at[part], weight[part]) if old is None else (np.concatenate([old.at, at[part]]), np.concatenate([old.weight, weight[part]]))
            self.blue[key] = Node(self.data, *parts)

    def _compatible(self, red: int, blue: Node) -> bool:
        pairs: list[tuple[int | Node, Node]] = [(red, blue)]
        while pairs:
            a, b = pairs.pop()
            one = a.count if isinstance(a, Node) else self.count[a].tolist()
            n, m = sum(one), b.total
            most = self.bound * (1 / math.sqrt(n or 1) + 1 / math.sqrt(m or 1))
            if most >= 1:
                continue
            if n and m and any(abs(x / n - y / m) > most for x, y in zip(one, b.count, strict=True)):
                return False
            for c in range(len(SYMBOLS)):
                if b.count[c] and one[c]:
                    to = a.child(c) if isinstance(a, Node) else int(self.next[a, c]) if self.next[a, c] >= 0 else self.blue[a, c]
                    pairs.append((to, b.child(c)))
        return True

    def _merge(self) -> None:
        while self.blue:
            p, c = min(self.blue, key=lambda x: (-self.blue[x].total, x[0], SYMBOLS[x[1]]))
            node = self.blue.pop((p, c))
            for r in range(len(self.next)):
                self.blue[p, c] = node
                fits = self._compatible(r, node)
                del self.blue[p, c]
                if fits:
                    self.next[p, c] = r
                    self._move(r, node.at, node.weight)
                    break
            else:
                self.next[p, c] = len(self.next)
                self._promote(node.at, node.weight)

    def _finish(self, floor: float = 0.5) -> None:
        """Tables (state, symbol): log probability of the symbol, and the state after it (0 after one that was never seen)."""
        self.log = np.log((self.count[:, :-1] + floor) / (self.count.sum(1, keepdims=True) + floor * self.count.shape[1]))
        self.after = np.maximum(self.next, 0)
        del self.data, self.blue


def pair_counts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How often each symbol follows each two symbols in the strings that begin at ``starts`` and fill the data; ``kinds`` stands for the start."""
    kinds = len(SYMBOLS)
    code = _CODE[data].astype(np.int64)
    last = np.concatenate([[kinds], code])[:-1]
    last[starts] = kinds
    before = np.concatenate([[kinds], last])[:-1]
    before[starts] = kinds
    return np.bincount((before * (kinds + 1) + last) * kinds + code, minlength=(kinds + 1) ** 2 * kinds).reshape(-1, kinds)


def joined(values: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of ASCII strings."""
    data = np.frombuffer("".join(values).encode(), np.uint8)
    ends = np.cumsum([len(v) for v in values], dtype=np.int64)
    return data, ends - np.array([len(v) for v in values], np.int64), ends


class Plain:
    """A second-order chain over symbols, fitted to unlabelled runs, or to the sum of them and of ``counts``: what candidates look like that are no credentials."""

    def __init__(self, words: list[str], counts: np.ndarray | int = 0, floor: float = 0.5):
        kinds = len(SYMBOLS)
        # a state is the last two symbols; ``kinds`` stands for the start
        self.after = ((np.arange((kinds + 1) ** 2) % (kinds + 1) * (kinds + 1))[:, None] + np.arange(kinds)).astype(np.int32)
        self.start = (kinds + 1) ** 2 - 1
        counts = pair_counts(*joined(words)[:2]) + counts
        one = counts.reshape(kinds + 1, kinds + 1, kinds).sum(0) + floor  # by the last symbol alone: what a rare pair falls back to
        one = np.tile(one / one.sum(1, keepdims=True), (kinds + 1, 1))
        self.log = np.log((counts + 4 * one) / (counts.sum(1, keepdims=True) + 4))


LONG = 1024


def likelihoods(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, log: np.ndarray, after: np.ndarray, first: int) -> np.ndarray:
    """The log likelihood of each string, all strings together one character at a time; those of over ``LONG`` characters one by one."""
    out = np.zeros(len(starts))
    sizes = ends - starts
    open_, k = np.flatnonzero(sizes <= LONG), 0
    state = np.full(len(open_), first, np.int32)
    while len(open_):
        code = _CODE[data[starts[open_] + k]]
        out[open_] += log[state, code]
        state = after[state, code]
        k += 1
        more = sizes[open_] > k
        open_, state = open_[more], state[more]
    table, step = log.tolist(), after.tolist()
    for i in np.flatnonzero(sizes > LONG).tolist():
        now, total = first, 0.0
        for code in _CODE[data[starts[i] : ends[i]]].tolist():
            total += table[now][code]
            now = step[now][code]
        out[i] = total
    return out


def fold_of(value: str) -> int:
    return xxhash.xxh3_64_intdigest(value.encode()) & 1


def folds_counted(runs: list[str]) -> np.ndarray:
    """The pair counts of each fold of distinct runs."""
    by: tuple[list[str], list[str]] = ([], [])
    for r in runs:
        by[fold_of(r)].append(r)
    return np.stack([pair_counts(*joined(x)[:2]) for x in by])


class Model:
    """``labels`` are known credentials, or the numbers of them by their symbols; ``runs`` unlabelled strings, or the pair counts of their folds, for which ``calibrate`` is to follow."""

    def __init__(self, labels: list[str] | Mapping[str, int], runs: list[str] | np.ndarray = (), alpha: float = ALPHA, threshold: float = THRESHOLD, made: list[str] | None = None):
        known = Counter(labels if isinstance(labels, Mapping) else map(symbols, labels))
        self.automaton = Automaton(known + Counter(map(symbols, made_by_rule() if made is None else made)), alpha)
        counts = runs if isinstance(runs, np.ndarray) else folds_counted(runs)
        self.plain = Plain(plain_words(), counts.sum(0))
        self.others = [Plain(plain_words(), counts[1 - k]) for k in range(2)]
        self.runs = int(counts[:, self.plain.start].sum())
        self.threshold = threshold
        if not isinstance(runs, np.ndarray):
            self.calibrate(lambda k: np.sort(self.held_out(runs))[::-1][k : k + 1].tolist())

    def calibrate(self, kth, further: int = 0) -> None:
        """Raises the threshold to the score that one in ``FALSE_OF`` runs, or runs and ``further`` strings, is above; ``kth`` gives a list of the k-th highest score that one has, or an empty one if that is under the threshold."""
        if (n := self.runs + further) >= FALSE_OF // 2:
            self.threshold = max([self.threshold, *kth(n // FALSE_OF)])

    def held_out(self, values: list[str]) -> np.ndarray:
        """The scores of runs, each under the chain of the fold that it is not in."""
        fold, out = np.array([fold_of(v) for v in values], np.int64), np.zeros(len(values))
        for k in range(2):
            out[fold == k] = self.scored(*joined([values[i] for i in np.flatnonzero(fold == k)]), self.others[k])
        return out

    def higher(self, values: list[str]) -> np.ndarray:
        """The scores of parts of runs, each under the chain of the fold that gives more."""
        return np.maximum(*(self.scored(*joined(values), plain) for plain in self.others))

    def scored(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, plain: Plain | None = None) -> np.ndarray:
        """How much likelier each string is as a credential than as an unlabelled run, in bits."""
        plain = plain or self.plain
        mine = likelihoods(data, starts, ends, self.automaton.log, self.automaton.after, 0)
        return (mine - likelihoods(data, starts, ends, plain.log, plain.after, plain.start)) / math.log(2)

    def scores(self, values: list[str]) -> np.ndarray:
        return self.scored(*joined(values))

    def findings(self, column: pa.Array) -> tuple[list[list[tuple]], list[list[tuple]]]:
        """Per text of a batch: its base findings, and all findings: (kind, start, end, start of the value, its end) in code points."""
        texts = texts_of(column)
        base = all_base(texts)
        data, offsets = raw(texts)
        added: dict[int, list[tuple[int, int]]] = {}
        for letters in (_RUN, _PART):
            owner, starts, ends = long_runs(data, offsets, letters=letters)
            hit = self.scored(data, starts, ends) >= self.threshold
            for d, a, b in zip(owner[hit].tolist(), starts[hit].tolist(), ends[hit].tolist(), strict=True):
                added.setdefault(d, []).append((a - int(offsets[d]), b - int(offsets[d])))
        spans = [list(x) for x in base]
        for d, found in added.items():
            body = data[offsets[d] : offsets[d + 1]]
            chars = np.concatenate([[0], np.cumsum((body & 0xC0) != 0x80)])
            taken = [(x[1], x[2]) for x in base[d]]
            for a, b in sorted(((int(chars[a]), int(chars[b])) for a, b in found), key=lambda x: (x[0] - x[1], x[0])):
                if not any(x <= a and b <= y for x, y in taken):
                    taken.append((a, b))
                    spans[d].append((3, a, b, a, b))
            spans[d].sort(key=lambda x: (x[1], x[0]))
        return base, spans


def plain_words(seed: int = 11, n: int = 400) -> list[str]:
    """Unlabelled look-alikes by rule: dotted and hyphenated words, paths, dates, versions and numbers."""
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("etaoinshrdlucmfwypvbgk") for _ in range(pick.randint(2, 11)))
    number = lambda: str(pick.randint(0, 10 ** pick.randint(1, 4)))
    out = []
    for k in range(n):
        parts = [pick.choice((word, word, word, number))() for _ in range(pick.randint(3, 6))]
        parts = [p.title() if pick.random() < 0.3 else p for p in parts]
        out.append("-./_="[k % 5].join(parts) if k % 3 else pick.choice("-./_").join(number() for _ in range(6)))
    return out


def fitted(docs: DataFrame, text: str = "text", alpha: float = ALPHA, threshold: float = THRESHOLD) -> Model:
    """The model of a corpus, from all its distinct labelled strings, unlabelled runs and their parts."""
    spark = docs.sparkSession
    found = stored(strings_of(docs, text), "secret-strings")
    candidates = found.where(F.col("kind") < LABEL)
    form = F.translate("value", "".join(_SYMBOL), "".join(_SYMBOL.values()))
    labels = {r["form"]: r["count"] for r in found.where(F.col("kind") == LABEL).groupBy(form.alias("form")).count().collect()}

    def by_kind(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[str]]]:
        for batch in cut(batches, "value"):
            yield tuple(batch.column("value").filter(pc.equal(batch.column("kind"), kind)).to_pylist() for kind in (RUN, PART))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n_parts = np.zeros(SHAPE, np.int64), 0
        for runs, parts in by_kind(batches):
            total += folds_counted(runs)
            n_parts += len(parts)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([*cells.tolist(), -1], pa.int64()), pa.array([*total.ravel()[cells].tolist(), n_parts], pa.int64())], ["cell", "n"])

    counts, n_parts = np.zeros(SHAPE, np.int64), 0
    for r in candidates.mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        if r["cell"] < 0:
            n_parts = r["n"]
        else:
            counts.ravel()[r["cell"]] = r["n"]
    model = Model(labels, counts, alpha, threshold)
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs, parts in by_kind(batches):
            for kind, high in ((RUN, shared.value.held_out(runs)), (PART, shared.value.higher(parts))):
                high = high[high > threshold]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(high), kind, np.int32)), pa.array(high, pa.float64())], ["kind", "score"])

    scores = stored(candidates.mapInArrow(score, "kind int, score double"), "secret-scores").orderBy(F.desc("score"))
    for own, further in [(scores.where(F.col("kind") == RUN), 0)] + [(scores, n_parts)] * (n_parts > 0):
        model.calibrate(lambda k: [r["score"] for r in own.offset(k).limit(1).collect()], further)  # noqa: B023 - called at once
    return model


def written(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b, *_ in spans)


FOUND_SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base string, spans string, n_added bigint"


def secret_scan(docs: DataFrame, doc_id="doc_id", text="text", alpha=ALPHA, threshold=THRESHOLD) -> DataFrame:
    """One row per document: counts of base findings, base and all spans as kind:start:end lists, and how many were added."""
    with scratch(docs.sparkSession):
        model = fitted(docs, text, alpha, threshold)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, "text"):
            base, spans = model.findings(batch.column("text"))
            kinds = [[sum(x[0] == k for x in found) for found in base] for k in range(3)]
            values = [batch.column("doc_id"), *(pa.array(k, pa.int64()) for k in kinds), pa.array([written(x) for x in base], pa.string()), pa.array([written(x) for x in spans], pa.string())]
            added = pa.array([len(x) - len(y) for x, y in zip(spans, base, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([*values, added], ["doc_id", "n_assign", "n_access", "n_hex", "base", "spans", "n_added"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(score, FOUND_SCHEMA)


def masked(text: str, spans: list, mask: str = MASK) -> str:
    """The text with the values of the spans, united where they overlap, replaced by the mask."""
    out, at = [], 0
    for a, b in sorted((x[3], x[4]) for x in spans):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mask]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, doc_id="doc_id", text="text", size: str | None = "n_chars", alpha=ALPHA, threshold=THRESHOLD) -> DataFrame:
    """All rows of docs with the values of their secrets masked; ``size``, if it is a column, gets the new number of characters of changed texts."""
    with scratch(docs.sparkSession):
        model = fitted(docs, text, alpha, threshold)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, text):
            at, new = batch.schema.names.index(text), {}
            for d, spans in enumerate(model.findings(batch.column(at))[1]):
                if spans:
                    new[d] = masked(batch.column(at)[d].as_py(), spans)
            if new:
                texts = batch.column(at).to_pylist()
                for d, t in new.items():
                    texts[d] = t
                columns = list(batch.columns)
                columns[at] = pa.array(texts, columns[at].type)
                if size in batch.schema.names:
                    k = batch.schema.names.index(size)
                    sizes = columns[k].to_pylist()
                    for d, t in new.items():
                        sizes[d] = len(t)
                    columns[k] = pa.array(sizes, columns[k].type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return docs.mapInArrow(clean, docs.schema)


def op5_secrets(spark, sf_dir):
    rows = secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")
