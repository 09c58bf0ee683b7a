"""Plain definitions that the operators are compared with."""

import random


def words(text, lower=False):
    found = (text or "").encode().split()
    return [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in found] if lower else found


def rooted(nodes, links):
    """Smallest node that each node is connected with."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def prose(seed, n, vocabulary=400):
    """Reproducible text of ``n`` made-up words."""
    rng = random.Random(seed)
    return " ".join(f"w{int(rng.random() ** 2 * vocabulary)}" for _ in range(n))


def edited(text, seed, share):
    """The text with about ``share`` of its words replaced."""
    rng = random.Random(seed)
    return " ".join(f"x{seed}{i}" if rng.random() < share else w for i, w in enumerate(text.split(" ")))


def mixed_texts():
    """Empty, null, long, equal, nearly equal and odd texts."""
    base = [prose(i, 60 + 20 * i) for i in range(6)]
    texts = ["", None, " \n\t ", "one", "A b A b a B c", "é   ñ　ö <|endoftext|> x", base[0], base[0], base[1]]
    texts += [edited(base[i % 6], i, 0.02) for i in range(12)]
    texts += [base[2] + " " + base[3], "a " * 90, "ab ab " * 40 + base[4], prose(99, 5000), "x" * 3000, "don't  stop\r\n 12 2,5 |!"]
    return list(enumerate(texts))
