"""A small documents table with every awkward case, and plain versions of what the operators compute."""

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, doc string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(lower(text))


def shingle_set(text, k):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def texts(seed=1, n=60):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    line = lambda k: " ".join(rnd.choice(vocabulary) for _ in range(k))
    hot = line(30)
    out = []
    for i in range(n):
        body = [line(rnd.randint(3, 40)) for _ in range(rnd.randint(1, 6))]
        if i % 3 == 0:
            body.insert(0, hot)
        out.append("\n".join(body))
    for i in range(12):  # near copies of one, each with one word changed
        w = out[1].split(" ")
        w[rnd.randrange(len(w))] = f"changed{i}"
        out.append(" ".join(w))
    for i in range(30):  # a larger group: one word of a long line changed in each
        w = line(60).split(" ") if i == 0 else base.split(" ")  # noqa: F821
        if i == 0:
            base = " ".join(w)
        else:
            w[i] = f"other{i}"
        out.append(" ".join(w))
    out += [out[2], out[2], out[5] + "\n" + out[6], "", " \n\t", "one", "One", "a b c", "x " * 500, "ab" * 400, "word " * 30000 + "end", "ÄÖ é 漢字 " + line(40), "ÄÖ é 漢字 tail"]
    return out


def documents(spark, seed=1, n=60):
    rows = [(i * 3, t, ["en", "de", None][i % 3], [None, "b", "a", "a"][i % 4], len(t), i, "clash") for i, t in enumerate(texts(seed, n))]
    rows += [(9001, None, None, None, None, None, None), rows[4], rows[4], (None, rows[7][1], "en", "a", 1, 1, "x"), (None, "no id here at all", "en", None, 1, 1, "x")]
    return spark.createDataFrame(rows, DOCS).repartition(3), rows
