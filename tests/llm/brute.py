"""Plain versions of the operators, for small inputs."""

import collections
import hashlib
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = re.compile(r"[\x20\x09-\x0D]")
LAST = 1 << 63


def sha(data):
    return hashlib.sha256(data).hexdigest()


def first_starts(docs, units, k):
    first = {}
    for doc, text in docs:
        u = units(text)
        for i in range(len(u) - k + 1):
            key = tuple(u[i : i + k])
            order = LAST if doc is None else doc
            first[key] = min(first.get(key, order), order)
    return first


def gone(docs, units, k):
    first = first_starts(docs, units, k)
    for doc, text in docs:
        u = units(text)
        lost = [False] * len(u)
        for i in range(len(u) - k + 1):
            if first[tuple(u[i : i + k])] < (LAST if doc is None else doc):
                lost[i : i + k] = [True] * k
        yield doc, u, lost


def words(text):
    return WORD.findall(text or "")


def substrings_of_words(docs, k=13):
    return [
        (doc, len(u), sum(lost), sha(" ".join(w for w, x in zip(u, lost) if not x).encode()))
        for doc, u, lost in gone(docs, words, k)
    ]


def substrings_of_bytes(docs, k=50):
    out = []
    for doc, u, lost in gone(docs, lambda t: (t or "").encode(), k):
        spans = sum(1 for i, x in enumerate(lost) if x and not (i and lost[i - 1]))
        out.append((doc, len(u), sum(lost), spans, sha(bytes(b for b, x in zip(u, lost) if not x))))
    return out


def statistics(text):
    text = text or ""
    w = words(text)
    triples = collections.Counter(zip(w, w[1:], w[2:]))
    cover = {j for i in range(len(w) - 2) if triples[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(cover), failed


def exact(docs):
    groups = collections.defaultdict(list)
    for doc, text in docs:
        groups[BLANK.sub("", text or "")].append((-len(text or ""), doc is None, doc or 0, doc))
    out = []
    for doc, text in docs:
        n = BLANK.sub("", text or "")
        keep = min(groups[n])[3]
        out.append((doc, keep, len(groups[n]), doc == keep, sha(n.encode())))
    return out


def shingles(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset(tuple(w) for _ in w)


def near(docs):
    sets = [shingles(t) for _, t in docs]
    label = list(range(len(docs)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = label[i], label[j]
                label = [y if v == x else v for v in label]
    out = []
    for i, (doc, _) in enumerate(docs):
        own = [d for (d, _), v in zip(docs, label) if v == label[i]] if sets[i] else [doc]
        least = min(own, key=lambda d: (d is None, d or 0))
        out.append((doc, len(sets[i]), least, doc == least))
    return out


def is_held_out(doc):
    return zlib.crc32(str(doc).encode()) % 4 == 2


ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def item_words(text):
    return ITEM_WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contaminated(docs, items, k=10):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = item_words(text)
        n = min(k, len(w))
        for i in range(len(w) - n + 1) if w else ():
            windows[tuple(w[i : i + n])].add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, seen = item_words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    seen |= found
        out.append((doc, len(w), len(hit), len(seen), sha(",".join(sorted(seen)).encode()), bool(hit)))
    return out


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(name.encode()) % 20
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        out += [(conv, turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def best_edits(rows):
    """Cheapest edits of (initial, must go, truncated) rows; of equal ones the least string."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, ""), "s": None, "u": None, "a": (0, "")}

    def with_inserts(best):
        for _ in range(4):
            for state in best:
                to = {"u": "a"}.get(state, "u")
                if best[to] is not None:
                    way = best[to][0] + 5, "I" + best[to][1]
                    best[state] = way if best[state] is None else min(best[state], way)
        return best

    best = with_inserts(best)
    for initial, gone, cut in reversed(rows):
        new = {}
        for state in best:
            ways = [(2 + best[state][0], "D" + best[state][1])]
            if not gone:
                if initial and initial in follow[state]:
                    ways.append((5 * cut + best[initial][0], "K" + best[initial][1]))
                to = {"u": "a"}.get(state, "u")
                ways.append((1 + 5 * cut + best[to][0], "R" + best[to][1]))
            new[state] = min(ways)
        best = with_inserts(new)
    return best[""]


def repaired(every):
    groups = {conv: [] for conv, *_ in every}
    for conv, *row in damage(every):
        groups[conv].append(row)
    out = []
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = {t for t, *_ in rows if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        counts, seen, coded = collections.Counter(), set(), []
        for _, role, text in rows:
            ended = text.rstrip(" \t\n\v\f\r")
            fault = None
            if not ended:
                fault = "blank"
            elif (role, text) in seen:
                fault = "duplicate"
            elif ended[-1] not in ".!?":
                fault = "truncated"
            seen.add((role, text))
            counts[fault] += 1
            coded.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(coded, coded[1:]))
        cost, audit = best_edits(coded)
        lines, rest, state = [], iter(rows), ""
        for letter in audit:
            row = next(rest) if letter != "I" else None
            if letter == "D":
                continue
            if letter == "K":
                state = row[1][0]
                lines.append(f"{row[1]}:{row[2]}")
            else:
                state = {"u": "a"}.get(state, "u")
                lines.append({"u": "user", "a": "assistant"}[state] + ":" + (row[2] if letter == "R" else ""))
        digest = sha("\n".join(lines).encode())
        faults = (counts["blank"], counts["duplicate"], counts["truncated"])
        out.append((conv, gaps, *faults, illegal, cost, audit, digest))
    return out


def token_bytes():
    """Both tokenizers of the public vocabularies: ids of a text, and the bytes of an id."""
    import sentencepiece
    from public_tokenizers import path
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel

    one = Tokenizer.from_file(path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    letters, rest = {}, 256
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE:
            letters[chr(b)] = b
        else:
            letters[chr(rest)], rest = b, rest + 1
    assert ByteLevel().decode(list(letters)[:0x40])

    def bytes_a(i):
        return bytes(letters[c] for c in one.id_to_token(i))

    def bytes_b(i):
        piece = two.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if two.is_byte(i) else piece.replace("▁", " ").encode()

    return (lambda t: one.encode(" " + t, add_special_tokens=False).ids), two.encode, bytes_a, bytes_b


def aligned(docs):
    ids_a, ids_b, bytes_a, bytes_b = token_bytes()
    groups_of, held = [], collections.Counter()
    for _, text in docs:
        groups = []
        if text:
            a, b = ids_a(text), ids_b(text)
            x, y = [bytes_a(i) for i in a], [bytes_b(i) for i in b]
            if b"".join(x) == b"".join(y) == b" " + text.encode():
                ends = [set(), set()]
                for side, parts in zip(ends, (x, y)):
                    n = 0
                    for p in parts:
                        n += len(p)
                        side.add(n)
                both = ends[0] & ends[1]
                for ids, parts, side in ((a, x, 0), (b, y, 1)):
                    n, g = 0, 0
                    for i, p in zip(ids, parts):
                        if g == len(groups):
                            groups.append(([], []))
                        groups[g][side].append(i)
                        n += len(p)
                        g += n in both
        groups_of.append(groups)
        held.update({(p, q) for one, two in groups for p in one for q in two})
    highest = collections.defaultdict(int)
    for (p, _), n in held.items():
        highest[p] = max(highest[p], n)
    out = []
    for (doc, _), groups in zip(docs, groups_of):
        links = [(p, q) for one, two in groups for p in one for q in two]
        text = ";".join(",".join(map(str, one)) + "|" + ",".join(map(str, two)) for one, two in groups)
        out.append(
            (
                doc,
                sum(len(one) for one, _ in groups),
                sum(len(two) for _, two in groups),
                len(groups),
                len(links),
                sum(held[link] == highest[link[0]] for link in links),
                sum(held[link] for link in links),
                sha(text.encode()) if groups else "",
            )
        )
    return out
