"""Brute-force versions over small tables."""

import re
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_list(text, k=5):
    w = WORD.findall((text or "").translate(LOWER))
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] if w else []


def near_groups(docs):
    """doc_id -> (n_shingles, component_id, kept)."""
    sets = {d: frozenset(shingle_list(t)) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def leaks(docs, items):
    """{(doc_id, item_id)} by weighted similarity over all windows of the item's length."""
    from collections import Counter

    out = set()
    for item, passage in items:
        w = len(WORD.findall((passage or "").translate(LOWER)))
        if not w:
            continue
        k = min(5, w)
        want = Counter(shingle_list(passage, k))
        m = w - k + 1
        for d, text in docs:
            words = WORD.findall((text or "").translate(LOWER))
            s = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
            size = min(m, len(s))
            if not size or not any(x in want for x in s):
                continue
            for at in range(len(s) - size + 1):
                have = Counter(s[at : at + size])
                both = sum((want & have).values())
                if both and both >= 0.75 * (m + size - both):
                    out.add((d, item))
                    break
    return out


def page_lines(html):
    """Lines of a page with "a" (apart), "i" (in an article) or "o" (open), by the standard library's parser; for pages without hidden or nested parts."""
    from html.parser import HTMLParser

    inline = {"b", "a", "i", "em"}
    away = {"nav", "header", "footer", "aside", "form", "head", "script", "style", "title"}

    class Lines(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.open, self.text, self.out = [], "", []

        def line(self):
            names = [n for n, _ in self.open]
            if text := " ".join(self.text.split()):
                zone = "a" if away & set(names) or any(ad for _, ad in self.open) else "i" if "article" in names else "o"
                if not {"script", "style", "title"} & set(names):
                    self.out.append((text, zone))
            self.text = ""

        def handle_starttag(self, tag, attrs):
            if tag == "br":
                self.text += " "
            elif tag not in inline:
                self.line()
                if tag in ("p", "li") and self.open and self.open[-1][0] == tag:
                    self.open.pop()
                if tag != "meta":
                    self.open.append((tag, dict(attrs).get("class") in ("ad", "comments")))

        def handle_endtag(self, tag):
            if tag not in inline:
                self.line()
                if tag in [n for n, _ in self.open]:
                    while self.open.pop()[0] != tag:
                        pass

        def handle_data(self, data):
            self.text += data

    parser = Lines()
    parser.feed(html or "")
    parser.close()
    parser.line()
    return parser.out


def common(a, b):
    """Length table of longest common subsequences, and the places in a on one of them."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    out = set()
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.add(i)
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def main_texts(pages):
    """page_id -> (text, lines deleted by differencing): all pages of a host in the order of their paths."""
    from urllib.parse import urlsplit

    rows = sorted((urlsplit(u).netloc.lower(), urlsplit(u).path, p, page_lines(h)) for p, u, h in pages)
    out = {}
    for at, (host, _, page, lines) in enumerate(rows):
        own, shared = [t for t, _ in lines], set()
        for others in (rows[:at][::-1], rows[at + 1 :]):
            near = next(([t for t, _ in r[3]] for r in others if r[0] == host and [t for t, _ in r[3]] != own), None)
            first = next((r for r in others if [t for t, _ in r[3]] != own), None)
            if near and first[0] == host:
                shared |= common(own, near)
        gone = {i for i in shared if lines[i][1] != "i"}
        stays = [i for i, (_, z) in enumerate(lines) if z != "a"]
        out[page] = " ".join(own[i] for i in ([i for i in stays if i not in gone] or stays)), len(gone)
    return out
