"""Definitions, computed the slow way."""


def bwt(docs):
    """Symbols before the sorted suffixes of all documents, ties in document order."""
    empty = b"" if docs and isinstance(docs[0], bytes) else ""
    suffixes = sorted((t[i:], d, i) for d, t in enumerate(docs) for i in range(len(t) + 1))
    return [docs[d][i - 1:i] if i else (b"\x02" if empty == b"" else "\x02") for _, d, i in suffixes]


def runs(symbols):
    out = []
    for s in symbols:
        if out and out[-1][0] == s:
            out[-1][1] += 1
        else:
            out.append([s, 1])
    return [tuple(r) for r in out]


def mutate(rnd, text, rate, alphabet):
    out = []
    for ch in text:
        r = rnd.random() / rate
        if r < 1 / 3:
            continue
        out.append(rnd.choice(alphabet) if r < 2 / 3 else ch)
        if 2 / 3 <= r < 1:
            out.append(rnd.choice(alphabet))
    return "".join(out)


def invert(symbols, n_docs):
    """Documents of a transform: follow each document backwards from its end."""
    order = sorted(range(len(symbols)), key=lambda i: (symbols[i], i))
    step = {i: k for k, i in enumerate(order) if symbols[i] != "\x02"}
    shift = sum(s == "\x02" for s in symbols)
    docs = []
    for d in range(n_docs):
        i, text = d, []
        while symbols[i] != "\x02":
            text.append(symbols[i])
            i = step[i] - shift + n_docs
        docs.append("".join(reversed(text)))
    return docs


def matching_statistics(base_index_text, docs):
    """(doc, off) -> (pos, len, smaller) from all comparisons with base suffixes."""
    sufs = sorted((base_index_text[p:], p) for p in range(len(base_index_text) + 1))
    out = {}
    for d, t in enumerate(docs):
        for i in range(len(t)):
            s = t[i:] + "\x02"
            share = [next((k for k, (a, b) in enumerate(zip(s, x)) if a != b), min(len(s), len(x))) for x, _ in sufs]
            best = max(share)
            above = [p for (x, p), k in zip(sufs, share) if k == best and x > s]
            out[d, i] = (above[0], best, True) if above else (
                [p for (x, p), k in zip(sufs, share) if k == best][-1], best, False)
    return out
