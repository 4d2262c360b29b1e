"""Plain Python versions of the text operators, for comparison."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from zlib import crc32

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def luhn(digits: str) -> bool:
    odd = [int(x) for x in digits[-1::-2]]
    even = [sum(divmod(2 * int(x), 10)) for x in digits[-2::-2]]
    return (sum(odd) + sum(even)) % 10 == 0


def pii(text: str | None) -> list[tuple[str, int, int]]:
    text, out = text or "", []
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], ("email", "ip", "card", "phone").index(s[0])))


def decontaminate(docs: list[tuple], items: list[tuple]) -> list[tuple]:
    windows = defaultdict(set)
    for item, text in items:
        w = BENCH_WORD.findall((text or "").translate(UPPER))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(str(item))
    out = []
    for doc, text in docs:
        w = BENCH_WORD.findall((text or "").translate(UPPER))
        hit, found = set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if (got := windows.get(tuple(w[i : i + size]))) is not None:
                    hit.update(range(i, i + size))
                    found |= got
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def repeats(docs: list[tuple], length: int = 35) -> list[tuple]:
    words = [SPACE_WORD.findall(text or "") for _, text in docs]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for (doc, _), w in zip(docs, words, strict=True):
        gone = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone.update(range(i, i + length))
        out.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def unigram(docs: list[tuple]) -> list[tuple]:
    tokens = [[*SPACE_WORD.findall((text or "").translate(UPPER)), None] for _, text in docs]
    held = [doc is not None and crc32(str(doc).encode()) % 5 == 1 for doc, _ in docs]
    counts = Counter(t for (doc, _), ts, h in zip(docs, tokens, held, strict=True) if not h and doc is not None for t in ts)
    n, v = sum(counts.values()), len(counts)
    return [(doc, h, len(ts), sum(t in counts for t in ts), n, sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)) for (doc, _), ts, h in zip(docs, tokens, held, strict=True)]


def quality(docs: list[tuple]) -> list[tuple]:
    out = []
    for doc, text in docs:
        text = text or ""
        w = SPACE_WORD.findall(text)
        seen, dup = set(), 0
        for line in text.split("\n"):
            if SPACE_WORD.search(line):
                dup += line in seen
                seen.add(line)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        count = Counter(grams)
        rep = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
        out.append((doc, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)))
    return out


def shingles(text: str | None) -> Counter:
    w = BENCH_WORD.findall((text or "").translate(UPPER))
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def near_classes(docs: list[tuple], threshold: float = 0.8) -> dict:
    """Least id of each row's class, by all pairs."""
    s = [shingles(t) or Counter([t] if t else []) for _, t in docs]  # without a word: the text itself
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if s[i] and s[j] and root(i) != root(j):
                common = sum((s[i] & s[j]).values())
                if common and common / (sum(s[i].values()) + sum(s[j].values()) - common) >= threshold:
                    parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return {i: least.get(root(i)) for i in range(len(docs))}


def naive_bayes(model, text: str) -> tuple[str, float]:
    """Language and probability, n-gram by n-gram."""
    clean = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
    padded, z = f" {clean} ", list(model.prior)
    for i in range(len(padded)):
        h = 0
        for n in range(1, 5):
            if i + n > len(padded):
                break
            h = (h * 0x100000001B3 + ord(padded[i + n - 1]) + n) % 2**64
            bucket = h * 0x9E3779B97F4A7C15 % 2**64 >> (64 - model.bits)
            z = [a + float(w[bucket]) for a, w in zip(z, model.weights, strict=True)]
    top = max(z)
    p = [math.exp(a - top) for a in z]
    return model.langs[p.index(max(p))], max(p) / sum(p)


def mcd(v):
    """Centre and scatter of the half of least determinant, by concentration steps from many starts."""
    import numpy as np

    rng, best = np.random.default_rng(0), None
    for _ in range(200):
        half = rng.choice(len(v), 6, replace=False)
        for _ in range(60):
            c, s = v[half].mean(0), np.cov(v[half].T, bias=True) + 1e-12 * np.eye(v.shape[1])
            d = np.einsum("ij,jk,ik->i", v - c, np.linalg.inv(s), v - c)
            new = np.sort(np.argsort(d)[: (len(v) + 1) // 2])
            if np.array_equal(new, half):
                break
            half = new
        det = np.linalg.det(np.cov(v[half].T, bias=True))
        if best is None or det < best[0]:
            best = det, v[half].mean(0), np.cov(v[half].T, bias=True)
    return best[1:]


def toxic(model, text: str | None) -> float:
    """Score of a text, feature by feature."""
    import numpy as np

    from lakelink.llm import textbuf, toxicity

    shift, found = 64 - toxicity.BITS, set()
    for w in BENCH_WORD.findall((text or "").translate(UPPER)):
        raw = np.frombuffer(w.encode(), np.uint8)
        found.add(int(textbuf.word_hashes(textbuf.words(raw, np.array([0, len(raw)]), textbuf.ALNUM))[0]) >> shift)
        marked = b"^" + w.encode() + b"$"
        for i in range(len(marked) - 4):
            found.add(int(textbuf.mix(np.array([int.from_bytes(marked[i : i + 5], "big") + 7], np.uint64))[0]) >> shift)
    return 1 / (1 + math.exp(-(model.bias + sum(float(model.weights[f]) for f in found))))


def secret_scores(model, text: str) -> list[tuple[int, int, float]]:
    """(start, end, share of trees) of the candidates of an ASCII text."""
    from pyspark.ml.linalg import Vectors

    from lakelink.llm import secrets

    spans = [m.span(2) if m.group(2) is not None else m.span(3) for m in re.finditer(secrets.PATTERN, text)]
    out = []
    for i, (start, end) in enumerate(spans):
        v = text[start:end][: secrets.HEAD]
        b = text[spans[i - 1][1] if i else 0 : start][-secrets.NEAR :]
        a = text[end : spans[i + 1][0] if i + 1 < len(spans) else len(text)][: secrets.NEAR]
        c = "".join("l" if "a" <= x <= "z" else "u" if "A" <= x <= "Z" else "d" if "0" <= x <= "9" else "o" for x in v)
        n = len(v)
        has = lambda pattern, x: float(bool(re.search(pattern, x)))
        f = [
            min(n, 200), (n - len(re.sub("lu|ul|ld|dl|ud|du|lo|ol|do|od|uo|ou", "", c))) / n, len(re.sub(r"(.)\1*", r"\1", c)) / n, len(set(v)) / min(n, 40), c.count("d") / n, c.count("u") / n,
            len(re.findall(secrets.PAIRS, v.lower())) / n, (n - len(re.sub(secrets.WORDS, "", v.lower()))) / n, len(re.findall("[/._-]", v)) / n,
            has(secrets.KEY_START, v), has(r"[=:][ \t\"']*$", b), has(secrets.SECRET_NEAR, b), has(secrets.OTHER_NEAR, b + " " + a), has("^[0-9a-f]+$|^[0-9A-F]+$", v), has("^[0-9 ._+-]+$", v),
        ]
        out.append((start, end, sum(t.predict(Vectors.dense(f)) for t in model.trees) / len(model.trees)))
    return out
