"""The projection of documents, page by page and line by line: what the column version is held against."""

import re

from pagemill.functions import normalize as N

P, L, SOFT = "\n\n", "\n", "­"
WHITE = f"[{N.WHITE}]"


def boxed(b):
    return len(b["box"] or []) == 4


def place(done, x, near, edge, other, sign):
    """Where x goes among lines: behind the last that needn't follow it."""

    def before(e):
        a, b = x["box"][edge], e["box"][edge]
        d = x["box"][other] - e["box"][other] if abs(a - b) < min(x["font_size"] or 0, e["font_size"] or 0) * near else sign * (a - b)
        return d < 0

    return max((i + 1 for i, e in enumerate(done) if not before(e)), default=0)


def by_insertion(rows, *how):
    out = []
    for x in rows:
        out.insert(place(out, x, *how), x)
    return out


def order(rows):
    if len(rows) < 2 or not all(map(boxed, rows)):
        return rows
    if sum(b["direction"] == "vertical" for b in rows) > 0.65 * len(rows):
        return by_insertion(rows, 0.5, 0, 1, -1)
    across = sorted(rows, key=lambda b: b["box"][0])
    for i in range(2, len(across) - 1):
        font = 12 if across[i]["font_size"] is None else across[i]["font_size"]
        if across[i]["box"][0] - max(b["box"][2] for b in across[:i]) > 2 * font:
            return sorted(across[:i], key=lambda b: b["box"][1]) + sorted(across[i:], key=lambda b: b["box"][1])
    return by_insertion(rows, 0.4, 1, 0, 1)


def middle(values, other):
    good = sorted(v for v in values if v > 0)
    return good[len(good) // 2] if good else other


def margin(b, height):
    if not height or not boxed(b) or len(b["text"]) > 100:
        return ""
    zone = "top" if b["box"][3] < 0.09 * height else "bottom" if b["box"][1] > 0.91 * height else ""
    text = N.js_trim(b["text"])
    if zone and re.fullmatch(WHITE.replace("[", r"[0-9０-９ivxlcdmIVXLCDM—–\-·第页頁") + "+", text):
        return "page-number"
    return zone and f"{zone}:{re.sub('[0-9０-９]+', '#', text)}"


CJK = re.compile("[　-ヿ㐀-鿿豈-﫿＀-￯]")


def starts_block(t):
    head = t.lstrip(N.WHITE_CHARS)
    tests = rf"[•●■◆・※]|[-*]{WHITE}|[0-9０-９]+([.．](?![0-9０-９])|[)）、])|[（(][0-9]+[）)]|[一二三四五六七八九十]+[、．]|[「『“]"
    return bool(re.match(tests, head) or re.match(rf"(?i)第[一二三四五六七八九十百千〇零0-9]+[章节部篇]|Chapter{WHITE}+[0-9]+|序言\Z|目录\Z", N.js_trim(t)) or re.match(" {2}|\t|　", t))


def step(a, b):
    return a["box"][0] - b["box"][0] if a["direction"] == "vertical" else b["box"][1] - a["box"][1]


def between(a, b, mode, body):
    """body: (size, step) of the page, or None between pages."""
    if mode == "original":
        return L if body else P
    ended = re.search("[。！？.!?][」』”’\"')）\\]]*\\Z", N.js_trim(a["text"]))
    placed = body is not None and boxed(a) and boxed(b)
    k = int(a["direction"] == "vertical")
    p, q, f, g = a["box"], b["box"], a["font_size"], b["font_size"]
    if starts_block(b["text"]) or a["direction"] != b["direction"] or (placed and min(p[k + 2], q[k + 2]) <= max(p[k], q[k])):
        return P
    if mode == "smart":
        if body is None and ended:
            return P
        on = False
        if placed and not ended and len(N.js_trim(a["text"])) >= 16:
            size, usual = body
            sizes = [size if x is None else x for x in (f, g)]
            on = max(sizes) <= 1.4 * max(1, min(sizes)) and 0.5 * size < step(a, b) <= 1.8 * usual and abs(q[k] - p[k]) <= 1.2 * size and max(f or 0, g or 0) <= 1.3 * size
        if not on and f and g and max(f, g) / min(f, g) > 1.22:
            return P
        if placed:
            font = max(f or 0, g or 0, 1)
            gap = p[0] - q[2] if k else q[1] - p[3]
            if not on and (gap > 1.15 * font or q[k] - p[k] > 0.85 * font):
                return P
            w, v = p[k + 2] - p[k], q[k + 2] - q[k]
            if max(w, v) < 12 * font:
                return L
            if ended and w < 0.78 * v:
                return P
    x, y = a["text"][-1:], b["text"][:1]
    return "" if re.match(WHITE, x) or re.match(WHITE, y) or CJK.match(x) or CJK.match(y) or x in ("-", SOFT) and x else " "


def chop(text, end):
    return text[: -len(end)] if text.endswith(end) else text


def document(pages, mode="smart", selected=None, cross_page=True):
    """Text and joined pages of (page_index, height, blocks) without readings and tables."""
    pages = sorted(pages, key=lambda p: p[0])
    complete = len(pages) >= (len(pages) if selected is None else selected)
    whole = complete and mode != "original"
    gone, words = set(), set()
    if whole:
        keys = [{margin(b, h) for b in blocks} for _, h, blocks in pages]
        for k in set().union(*keys) - {""}:
            n = sum(k in x for x in keys)
            if k == "page-number" or (len(pages) >= 3 and n >= max(3, -(-len(pages) * 6 // 10))):
                gone.add(k)
        words = {w.lower() for _, _, blocks in pages for b in blocks for w in re.findall(r"(?<![A-Za-z0-9_])[A-Za-z]{4,}(?![A-Za-z0-9_])", b["text"])}
    out, joined, last = "", 0, None
    for n, (index, height, blocks) in enumerate(pages):
        kept = [b for b in (blocks if mode == "original" else order(blocks)) if margin(b, height) not in gone]
        kept = [b if mode == "original" else {**b, "text": N.normalize_text(b["text"])} for b in kept]
        big = [b for b in kept if len(N.js_trim(b["text"])) >= 12] or kept
        size = middle([b["font_size"] or 0 for b in big], 20)
        moves = [step(a, b) for a, b in zip(kept, kept[1:]) if boxed(a) and boxed(b) and a["direction"] == b["direction"]]
        body = size, middle([m for m in moves if 0.5 * size < m < 2.5 * size], 1.3 * size)
        text = ""
        for i, b in enumerate(kept):
            if i:
                sep = between(kept[i - 1], b, mode, body)
                if L not in sep:
                    text = chop(text, SOFT)
                    h, t = re.search(r"[A-Za-z]{2,}-\Z", kept[i - 1]["text"]), re.match("[a-z]{2,}", b["text"])
                    if h and t and (h[0][:-1] + t[0]).lower() in words:
                        text = chop(text, "-")
                text += sep
            text += b["text"]
        if n:
            sep = between(last, kept[0], mode, None) if complete and cross_page and last and kept and index == pages[n - 1][0] + 1 else P
            if L not in sep:
                joined += 1
                out = chop(out, SOFT)
            out += sep
        out += text
        last = kept[-1] if kept else None
    return out, joined
