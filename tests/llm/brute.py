"""Brute-force versions that the operators are held against."""

import re
from collections import defaultdict

BLANK = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(words, words[1:], words[2:], words[3:], words[4:])) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def near_components(texts):
    """{id: smallest id reachable} over all pairs."""
    sets = {k: shingles(t) for k, t in texts.items()}
    parent = {k: k for k in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= 75 * max(len(x), len(y)) and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {k: root(k) for k in ids}, {k: len(s) for k, s in sets.items()}


def exact_groups(texts):
    groups = defaultdict(list)
    for k, t in texts.items():
        groups[BLANK.sub(" ", t or "")].append(k)
    return {k: (min(g), len(g)) for g in groups.values() for k in g}


def personal(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def secrets(text):
    rules = (
        (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 6),
        (r"AKIA[A-Z0-9]+", 0, 0, 20),
        (r"[0-9a-f]+", 0, 0, 24),
    )
    return sorted((m.start(), k, m.end()) for k, (p, flags, group, least) in enumerate(rules) for m in re.finditer(p, text or "", flags) if len(m[group]) >= least)


def spans(found, kinds):
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in found)


def language(dictionaries, text, narrow, block):
    """(language, margin, accepted) by encoding the text's letters with each dictionary anew; None for the language where there is no letter."""
    import unicodedata

    import zstandard

    kept = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in (text or "").lower())
    body = " ".join(w for w in kept.split(" ") if w).encode()
    if not dictionaries or not any(unicodedata.category(c)[0] == "L" for c in text or ""):
        return None, 0.0, False
    sizes = []
    for place, (lang, raw) in enumerate(dictionaries):
        params = zstandard.ZstdCompressionParameters(window_log=17, hash_log=16, chain_log=16, search_log=2, min_match=3, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)
        total = 0
        for at in range(0, len(body), block):
            held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=params)
            total += len(zstandard.ZstdCompressor(dict_data=held, compression_params=params).compress(body[at : at + block]))
        sizes.append((total, place, lang))
    (least, _, lang), *others = sorted(sizes)
    margin = 1 - least / others[0][0] if others else 1.0
    return lang, margin, margin > narrow


def narrow_margin(told):
    """The margin up to which all answers together are worth least."""
    return min([(0.0, 0.0), *((round(sum(w for x, w in told if x <= m), 6), m) for m, _ in told)])[1]
