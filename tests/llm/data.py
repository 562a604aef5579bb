"""Small documents with every awkward case: nulls, empty texts, ties, repeated rows, copies, shared passages, a very long text."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, doc long, row int, fp string"


def rows(seed: int = 1, n: int = 120) -> list[tuple]:
    rng = random.Random(seed)
    words = ["the", "Of", "and", "Thé", "ß", "re", "ing", "Über", "ón", "日本語", "x!", "#tag", "A|B", "<b>", "don't", "42", "q<|endoftext|>z", "<|END", "éa"]
    vocab = words + ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    say = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage, line = say(60), "A Common LINE that is surely longer than forty characters, " + say(4)
    texts = [None, "", " \t\n", "one", "a b c\n\nd", " x y z", "same same same same same " * 12, "x" * 500, "loop de loop " * 700]
    for k in range(n):
        parts = [say(rng.randint(1, 30)) for _ in range(rng.randint(1, 6))]
        if k % 3 == 0:
            parts.insert(rng.randint(0, len(parts)), rng.choice(["", "\t ", "  "]) + (line if k % 2 else line.upper()) + rng.choice(["", " ", "\r"]))
        if k % 4 == 0:
            parts.append("lead %d %s tail" % (k, passage))
        if k % 5 == 0:
            parts += parts[:1]
        texts.append("\n".join(parts))
    texts += [texts[20]] * 7 + [texts[30] + " end"] + [" ".join(w if i % 40 else "zz" for i, w in enumerate(texts[41].split()))]
    ids = list(range(0, 3 * len(texts), 3))
    rng.shuffle(ids)
    sources = ["b", "a", None, "ä", "", "z"]
    out = [(d, t, rng.choice(["en", None]), "b" if rng.random() < 0.4 else rng.choice(sources), None if t is None else len(t), 7, -1, 3, "clash") for d, t in zip(ids, texts)]
    return out + [out[15], out[15], (None, texts[12], None, None, None, 7, -1, 3, "clash"), (None, None, None, None, None, 7, -1, 3, "clash")]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(4)
