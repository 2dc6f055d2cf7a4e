"""Plain versions of the operators' contracts."""

import hashlib
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def near_duplicates(rows, width, percent):
    """{id: (set size, least id reachable)}"""
    sets = {}
    for i, text in rows:
        w = WORD.findall((text or "").encode().translate(LOWER))
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        shared = Counter(j for g in s for j in holders[g])
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for g in s:
            holders[g].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def repeats(texts, length):
    """(bytes, removed, spans, SHA-256 of what is kept) of each text."""
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + length] for b in bodies for k in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def measures(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)"""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    many = {g for g, n in Counter(grams).items() if n > 1}
    covered = {k + d for k, g in enumerate(grams) if g in many for d in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def secrets(text):
    """(counts, kind:start:end list) of the base patterns."""
    found = []
    for m in re.finditer(r"((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text or ""):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text or "") if len(m[0]) >= 32]
    kinds = ("assign", "access", "hex")
    return [sum(k == x[1] for x in found) for k in range(3)], ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(found))


def contamination(text, items, window=10):
    """(n_words, n_hit, sorted ids)"""
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(LOWER))
    own, hit, ids = words(text), set(), set()
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            g = w[k : k + window]
            for at in range(len(own) - len(g) + 1):
                if own[at : at + len(g)] == g:
                    hit.update(range(at, at + len(g)))
                    if i is not None:
                        ids.add(i)
    return len(own), len(hit), sorted(ids)


def latent_classes(votes, rules, families, rounds, prior, least_error, least_found):
    """Expectation-maximisation one document at a time: (class shares, probability of a bad vote of each class and rule)."""
    n = 1 + len(families)
    own = [[k > 0 and r in families[k - 1] for r in rules] for k in range(n)]
    start = [[0.5 if o else 0.05 for o in row] for row in own]
    share, table = [0.8] + [0.2 / len(families)] * len(families), [row[:] for row in start]
    for _ in range(rounds):
        given = []
        for v in votes:
            p = [s for s in share]
            for k in range(n):
                for r, x in enumerate(v):
                    p[k] *= table[k][r] if x < 0 else 1 - table[k][r] if x > 0 else 1
            given.append([x / sum(p) for x in p])
        share = [(sum(g[k] for g in given) + 1) / (len(votes) + n) for k in range(n)]
        for k in range(n):
            for r in range(len(rules)):
                bad = sum(g[k] for g, v in zip(given, votes, strict=True) if v[r] < 0)
                cast = sum(g[k] for g, v in zip(given, votes, strict=True) if v[r])
                table[k][r] = max((bad + prior * start[k][r]) / (cast + prior), least_found if own[k][r] else least_error)
    return share, table


class Article(HTMLParser):
    """Lines of the article of a well-formed page, by a tree walk of the standard library's parser."""

    def __init__(self, page, blocks, boilerplate, names, raw, void):
        super().__init__(convert_charrefs=True)
        self.lists = blocks, boilerplate, names, raw, void
        self.stack, self.lines, self.parts = [], [], []
        self.feed(page)
        self.close()
        self.end()

    def end(self):
        if text := " ".join("".join(self.parts).split()):
            self.lines.append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        blocks, boilerplate, names, raw, void = self.lists
        if tag in blocks:
            self.end()
        if tag == "br":
            self.parts.append(" ")
        if tag not in void:
            attrs = dict(attrs)
            words = {*(attrs.get("class") or "").lower().split(), *(attrs.get("id") or "").lower().split()} - {"header"}
            bad = tag in boilerplate or tag in raw or words & set(names) or "hidden" in attrs
            self.stack.append((tag, bool(bad)))

    def handle_endtag(self, tag):
        if tag in self.lists[0]:
            self.end()
        if tag in ("td", "th"):
            self.parts.append(" ")
        if any(t == tag for t, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if any(t in ("article", "main") for t, _ in self.stack) and not any(bad for _, bad in self.stack):
            self.parts.append(data)
