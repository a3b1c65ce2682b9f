"""Small odd tables."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1, n=120):
    """Documents with copies, near copies, shared passages and lines, odd texts and nulls."""
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(400)] + ["The", "the", "of", "ÉTÉ", "été", "a", "to"]
    prose = lambda k: [rng.choice(words) for _ in range(k)]
    passage, line = prose(30), "A Line that Many documents share"
    texts = []
    for i in range(n):
        w = prose(rng.choice([3, 4, 5, 12, 13, 14, 40, 80, 160]))
        if i % 5 == 0:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage
        t = " ".join(w)
        if i % 4 == 0:
            t = t.replace(" ", "\n", 2) + "\n" + (line.upper() if i % 8 else "\t " + line + " ") + "\n" + line
        texts.append(t)
    for i in range(0, n, 6):
        w = texts[i].split(" ")
        if len(w) > 30:
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w))
        texts.append(texts[i])
    texts += [None, "", " ", "\n\n", "one", "x y z", " ".join(prose(6000)), "日本語 テキスト", "a  b\tc\x0bd", "é" * 12 + "\n" + "É" * 12]
    ids = list(range(1, len(texts) + 1))
    rng.shuffle(ids)
    return [(d, t, rng.choice(["en", "de", None]), rng.choice(["hot", "hot", "hot", "cold", None]), None if t is None else len(t)) for d, t in zip(ids, texts)]
