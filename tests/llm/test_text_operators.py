"""Text operators against brute force, and their defined results on odd input."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewell.llm import chat, decontam, linededup, packing, pii, secrets, simhash, tokencount

DOCS = "doc_id long, text string, node int, key string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], DOCS)


# ---- line dedup


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return any(a[:k] + a[k + 1 :] == b for k in range(len(a)))


def lines_left(rows):
    """(doc_id, text) -> text after line dedup, by comparing all pairs."""
    seen = []
    for i, t in rows:
        for k, line in enumerate((t if t is not None else "").split("\n")):
            if s := line.strip(" \t\r"):
                seen.append(((i is not None, i or 0, k), s))
    gone = {p for p, s in seen if any(q < p and (s == u or one_edit(s, u)) for q, u in seen)}
    out = []
    for i, t in rows:
        out.append((i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i is not None, i or 0, k) not in gone)))
    return out


def test_line_dedup_matches_all_pairs(spark):
    r = random.Random(4)
    base = ["".join(r.choice("abc") for _ in range(n)) for n in (1, 2, 3, 8, 15, 16, 17, 40, 63, 64, 65, 130, 300)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(r.randint(1, 5)):
            x = list(r.choice(base))
            for _ in range(r.choice((0, 1, 1, 2))):
                k = r.randrange(len(x) + 1)
                r.choice((lambda x, k: x.insert(k, r.choice("abcd")), lambda x, k: x.pop(min(k, len(x) - 1)) if len(x) > 1 else None, lambda x, k: x.__setitem__(min(k, len(x) - 1), r.choice("abcé"))))(x, k)
            lines.append(r.choice(("", " ", "\t")) + "".join(x))
        rows.append((i, "\n".join(lines)))
    got = linededup.deduplicated(docs(spark, rows))
    assert sorted((x["doc_id"], x["text"]) for x in got.collect()) == sorted(lines_left(rows))


def test_line_dedup_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "same line\nsame line\r\n"), (4, "same line\nsame line\r\n"), (None, "same line"), (5, "x" * 30_000 + "\nok"), (6, "x" * 29_999 + "y")]
    table = docs(spark, rows).withColumnRenamed("node", "n_lines").withColumnRenamed("key", "pos")
    got = linededup.deduplicated(table)
    assert got.columns == ["doc_id", "text", "pos", "n_lines", "n_removed"]
    found = {(x["doc_id"], x["text"] and x["text"][:12], x["n_lines"], x["n_removed"]) for x in got.collect()}
    assert found == {(1, None, 0, 0), (2, "", 1, 0), (3, "\n\n", 3, 0), (4, "", 3, 2), (None, "same line", 1, 0), (5, "x" * 12, 2, 0), (6, "", 1, 1)}
    assert linededup.deduplicated(table.where("false")).count() == 0


# ---- decontamination


def brute_contamination(text, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words, hit, names = word.findall(low(text)), set(), set()
    for item, t in items:
        own = word.findall(low(t))
        for k in range(max(0, len(own) - 10) + 1 if own else 0):
            w = own[k : k + 10]
            for i in range(len(words) - len(w) + 1):
                if words[i : i + len(w)] == w:
                    hit.update(range(i, i + len(w)))
                    names.add(item)
    return len(words), len(hit), sorted(names)


def test_decontamination_matches_brute_force(spark):
    r = random.Random(2)
    vocabulary = ["alpha", "Beta", "gamma", "DELTA", "é1", "zwei", "of"]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.choice((0, 1, 3, 10, 12, 25))))) for k in range(12)] + [(50, None), (51, "of of of of of of of of of of of of")]
    rows = [(0, None), (1, ""), (2, "of " * 40)]
    for i in range(3, 60):
        words = [r.choice([*vocabulary, "noise", "other"]) for _ in range(r.randint(0, 60))]
        if i % 2:
            words[5:5] = (r.choice(items)[1] or "").split()
        rows.append((i, r.choice((", ", " ", "\n")).join(words)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x["doc_id"]: (x["n_words"], x["n_hit"], list(x["items"])) for x in decontam.contamination(docs(spark, rows), bench).collect()}
    assert got == {i: brute_contamination(t, items) for i, t in rows}

    long_items = [x for x in items if len((x[1] or "").split()) >= 10]
    clean = decontam.decontaminated(docs(spark, rows), spark.createDataFrame(long_items, "item_id long, text string")).collect()
    before = dict(rows)
    for x in clean:
        assert brute_contamination(x["text"], long_items)[1] == 0
        if not brute_contamination(before[x["doc_id"]], long_items)[1]:
            assert x["text"] == before[x["doc_id"]]
    assert [x["key"] for x in clean] == ["x"] * len(rows)


def test_decontamination_in_blocks_is_the_same(spark, monkeypatch):
    items = [(k, f"w{k} " * 11) for k in range(6)]
    rows = [(1, "w1 " * 12 + "x " + "w4 " * 10), (2, "w3 " * 9)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = decontam.contamination(docs(spark, rows), bench).orderBy("doc_id").collect()
    monkeypatch.setattr(decontam, "ITEMS_WORDS", 7)
    assert decontam.contamination(docs(spark, rows), bench).orderBy("doc_id").collect() == whole
    assert whole[0]["items"] == [1, 4] and whole[0]["n_hit"] == 22
    assert decontam.contamination(docs(spark, rows), bench.where("false")).agg({"n_hit": "sum"}).first()[0] == 0


def test_an_item_longer_than_a_block_keeps_all_its_windows(spark, monkeypatch):
    words = [f"w{k}" for k in range(60)]
    bench = spark.createDataFrame([(5, " ".join(words)), (6, "w3 w4"), (None, " ".join(words[20:45]))], "item_id long, text string")
    rows = [(k, f"x {' '.join(words[k : k + 10])} y") for k in range(51)] + [(99, " ".join(words[:9])), (100, " ".join(words))]
    whole = decontam.contamination(docs(spark, rows), bench).orderBy("doc_id").collect()
    assert all(x["n_hit"] == 10 and 5 in x["items"] for x in whole[:51]) and whole[51]["n_hit"] == 2 and whole[52]["n_hit"] == 60
    for n in (1, 11, 60, 61):
        monkeypatch.setattr(decontam, "ITEMS_WORDS", n if n > 1 else 13)
        assert decontam.contamination(docs(spark, rows), bench).orderBy("doc_id").collect() == whole


def test_decontaminated_in_blocks_is_the_same(spark, monkeypatch):
    w = [f"w{k}" for k in range(40)]
    items = [(1, " ".join(w[:12])), (2, " ".join(w[8:20])), (3, " ".join(w[25:35])), (4, " ".join(["left", *w[30:34], "right", "a", "b", "c", "d"]))]
    joined = " ".join([*w[25:30], *w[8:20], *w[30:35]])  # cutting item 2 brings item 3 together
    rows = [(1, "start " + " ".join(w[:20]) + " end"), (2, "x, " + joined + " y"), (3, None), (4, "clean Text"), (5, "")]
    table = docs(spark, rows).withColumn("n_chars", F.length("text").cast("long")).withColumn("spans", F.lit("own"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = decontam.decontaminated(table, bench).orderBy("doc_id").collect()
    monkeypatch.setattr(decontam, "ITEMS_WORDS", 3)
    assert decontam.decontaminated(table, bench).orderBy("doc_id").collect() == whole
    assert decontam.decontaminated(table, bench.orderBy(F.desc("item_id"))).orderBy("doc_id").collect() == whole
    assert [x["text"] for x in whole] == ["start  end", "x,  y", None, "clean Text", ""] and whole[0]["n_chars"] == 10 and {x["spans"] for x in whole} == {"own"}


def test_decontamination_marks_items_without_an_id(spark):
    bench = spark.createDataFrame([(None, "one two three"), (7, "four five"), (None, "four five")], "item_id long, text string")
    table = docs(spark, [(1, "x one two three y"), (2, "four five z")])
    got = {x["doc_id"]: (x["n_hit"], list(x["items"]), x["spans"]) for x in decontam.contamination(table, bench).collect()}
    assert got == {1: (3, [], "1:4"), 2: (2, [7], "0:2")}
    assert {x["doc_id"]: x["text"] for x in decontam.decontaminated(table, bench).collect()} == {1: "x  y", 2: " z"}


def test_fm_index_finds_all_occurrences():
    r = np.random.default_rng(1)
    seq = np.concatenate([np.append(r.integers(1, 4, n), 0) for n in (5, 1, 40, 40, 200)])
    index = decontam.FmIndex(seq, 3)
    patterns = np.unique(r.integers(1, 4, (50, 4)), axis=0)
    lo, hi = index.search(patterns.ravel(), np.arange(len(patterns)) * 4, 4)
    for p, a, b in zip(patterns, lo, hi, strict=True):
        want = [i for i in range(len(seq) - 3) if (seq[i : i + 4] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


# ---- PII and secrets


def base_pii(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(int(c) * 2, 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.findall("[0-9]", m[0])) <= 15]
    return out


def base_secrets(text):
    out = [("assign", *m.span()) for m in re.finditer(r"(?a)((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 12]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return out


def noise(r, parts, n):
    return "".join(r.choice(parts) for _ in range(n))


def test_pii_base_spans_match_plain_expressions(spark):
    r = random.Random(8)
    parts = ["a", "b.c", "@", "@x-1.de", ".", "1", "12", "255", "256.", "1.2.3.4", "+", "+1 (", ") ", "-", " ", "4111 1111 1111 1111", "4111111111111111", "é", "%", "_", "http://a.b/c", "iban DE89370400440532013000", "account no: 123-456-789"]
    rows = [(i, noise(r, parts, r.randint(0, 40))) for i in range(400)] + [(1000, None), (1001, ""), (1002, "9" * 5000), (1003, "İ a@b.cd")]
    got = pii.personal_data(docs(spark, rows)).collect()
    text = dict(rows)
    extra = set()
    for x in got:
        want = sorted(base_pii(text[x["doc_id"]] or ""), key=lambda s: (pii.BASE.index(s[0]), s[1]))
        said = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        spans = [s for s in x["spans"].split(",") if s]
        assert [s for s in spans if s.split(":")[0] in pii.BASE] == [s for s in said.split(",") if s], text[x["doc_id"]]
        assert x["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [x[f"n_{k}"] for k in pii.BASE] == [sum(w[0] == k for w in want) for k in pii.BASE]
        extra |= {s.split(":")[0] for s in spans} - set(pii.BASE)
    assert extra == {"url", "iban", "account"} and len(got) == len(rows)


def test_secret_base_spans_match_plain_expressions(spark):
    r = random.Random(9)
    body = "A" * 15 + "x" * 15  # no hexadecimal run of its own
    good = "ghp_" + body + secrets.base62(zlib.crc32(body.encode()))
    parts = ["password", "PassWD", "secret", "toKen", "token", "api_key", "APIKEY", "=", ": ", '"', "'", " ", "abcdef012345", "Zz9+/", "AKIA", "akia", "ABCDEFGH12345678", "0123456789abcdef", "é", "\n", good + " ", good[:-1] + "~"]
    rows = [(i, noise(r, parts, r.randint(0, 30))) for i in range(400)] + [(1000, None), (1001, ""), (1002, "İ token=abcdefghijkl")]
    got = secrets.secret_spans(docs(spark, rows)).collect()
    text = dict(rows)
    tokens = 0
    for x in got:
        want = sorted(base_secrets(text[x["doc_id"]] or ""), key=lambda s: (s[1], secrets.BASE.index(s[0])))
        said = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert x["base_sha256"] == hashlib.sha256(said.encode()).hexdigest(), text[x["doc_id"]]
        assert [x[f"n_{k}"] for k in secrets.BASE] == [sum(w[0] == k for w in want) for k in secrets.BASE]
        spans = [s for s in x["spans"].split(",") if s]
        assert [s for s in spans if not s.startswith("token:")] == [s for s in said.split(",") if s]
        tokens += len(spans) - len(want)
    assert tokens
    assert secrets.finder()(good[:-1] + ("0" if good[-1] != "0" else "1")) == []


# ---- token counts


def test_token_counts_match_plain_dynamic_programming(spark):
    pieces = tokencount.load_pieces(tokencount.default_model())
    trie = tokencount.Trie(pieces)
    r = random.Random(3)
    words = ["the", "there", "therefore", "Zürich", "日本語", "", "a" * 60, "😀x".encode("utf-16", "surrogatepass").decode("utf-16"), *("".join(r.choice("aeionrst▁é漢") for _ in range(r.randint(1, 20))) for _ in range(300))]

    def plain(word):
        text = "▁" + word
        best = [(0.0, 0)]
        for e in range(1, len(text) + 1):
            width = len(text[e - 1].encode())
            ways = [(best[e - 1][0] + trie.byte * width, best[e - 1][1] + width)]
            ways += [(best[s][0] + pieces[text[s:e]], best[s][1] + 1) for s in range(e) if text[s:e] in pieces]
            best.append(max(ways, key=lambda w: (w[0], -w[1])))
        return best[-1][1]

    words += ["".join(r.choice("aeionrst▁é漢") for _ in range(n)) for n in (60, 63, 64, 65, 66, 127, 1000, 5000)] + ["the" * 2000, "=" * 3000]
    for w in words:
        assert trie.counts([w]) == plain(w)
    held = len(trie.nodes)
    trie.counts(["x" + "ab" * 300_000])
    assert len(trie.nodes) <= held + tokencount.DEPTH and max(map(len, trie.known)) <= tokencount.DEPTH
    rows = [(1, "the there  therefore\nthe"), (2, None), (3, ""), (4, "the " * 3), (4, "the " * 3)]
    got = sorted((x["doc_id"], x["n_pretokens"], x["n_tokens"]) for x in tokencount.token_counts(docs(spark, rows)).collect())
    t = plain("the")
    assert got == [(1, 4, 2 * t + plain("there") + plain("therefore")), (2, 0, 0), (3, 0, 0), (4, 3, 3 * t), (4, 3, 3 * t)]


# ---- chat


def test_chat_links_quotes_and_orders_replies(spark):
    rows = [
        (1, 0, "u", "Hello there.\n\nSecond para\nmore", 0),
        (1, 1, "a", "> hello   there.\nHi!", 0),
        (1, 2, "u", "> > Hello there.\n> Hi!\nOk", 0),
        (1, 3, "a", None, 0),
        (1, 4, "u", "> Second para\n> more\n\nwhat\n", 0),
        (1, 5, "a", "> never said\nso", 0),
        (2, 0, "u", "> Hello there.", 0),
        (None, 0, "u", "> x", 0),
        (3, None, "u", "y", 0),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth int")
    got = {(x["conv_id"], x["turn"]): (x["parent_turn"], x["root_turn"], x["depth"], x["n_quoted"], x["text"]) for x in chat.formatted(table).collect()}
    assert got == {
        (1, 0): (None, 0, 0, 0, "Hello there.\n\nSecond para\nmore"),
        (1, 1): (0, 0, 1, 1, "Hi!"),
        (1, 2): (1, 0, 2, 2, "Ok"),
        (1, 3): (None, 3, 0, 0, ""),
        (1, 4): (0, 0, 1, 2, "what"),
        (1, 5): (None, 5, 0, 1, "so"),
        (2, 0): (None, 0, 0, 1, ""),
        (None, 0): (None, 0, 0, 1, ""),
        (3, None): (None, None, 0, 0, "y"),
    }
    assert chat.formatted(table.where("false")).count() == 0


def test_chat_links_interleaved_and_trimmed_quotes(spark):
    rows = [
        (1, 0, "u", "First line\nSecond line\nThird line"),
        (1, 1, "a", "something else"),
        (1, 2, "u", "> First  line\nyes\n> third line\nno"),
        (1, 3, "a", "> second line\n> Third line\ntrimmed"),
        (1, 4, "u", "> > Something else\n> yes\nouter line before whole deeper passage"),
        (1, 5, "a", "> Third\nnot a line"),
        (2, 0, "u", "one\ntwo"),
        (2, 1, "u", "one"),
        (2, 2, "u", "two"),
        (2, 3, "u", "> one\n> two"),
    ]
    got = {(x["conv_id"], x["turn"]): (x["parent_turn"], x["root_turn"], x["depth"]) for x in chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {
        (1, 0): (None, 0, 0),
        (1, 1): (None, 1, 0),
        (1, 2): (0, 0, 1),
        (1, 3): (0, 0, 1),
        (1, 4): (2, 0, 2),
        (1, 5): (None, 5, 0),
        (2, 0): (None, 0, 0),
        (2, 1): (None, 1, 0),
        (2, 2): (None, 2, 0),
        (2, 3): (0, 0, 1),
    }


def test_chat_long_chains(spark):
    rows = [(7, i, "u", (f"> said {i - 1}\n" if i else "") + f"said {i}") for i in range(70)]
    got = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert all(x["depth"] == x["turn"] and x["root_turn"] == 0 for x in got)


# ---- packing


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    r = random.Random(5)
    rows = [(0, None), (1, ""), (2, "word " * 9000), (3, "İstanbul don't a1b2 !!! <|endoftext|>"), (3, "same id")]
    rows += [(i, " ".join(r.choice(["Alpha,", "beta", "gamma's", "42", "éa."]) for _ in range(r.randint(1, 900)))) for i in range(4, 80)]
    got = packing.packed(docs(spark, rows)).collect()
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want.append((i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(tuple(x)[:5] for x in got) == sorted(want)
    by = {}
    for x in got:
        by.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for places in by.values():
        places.sort()
        assert [o for o, _ in places] == [0, *np.cumsum([n for _, n in places])[:-1].tolist()]
        assert sum(n for _, n in places) <= 4096
    assert len(by) <= -(-sum(w[3] for w in want) // 4096) + 1


def test_packing_encodes_decomposed_words_as_the_tokenizer(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    words = ["cafe\u0301", "u\u0308", "(Cafe\u0301)", "q\u0301!", "\u0301e.", "\u0958!", "\u0130!", "a\u0130.", "\u0915\u0947", "\u1100\u1161!", "A\u030a-", "caf\u00e9,"]
    words += [f"{a}{chr(c)}{b}" for c in range(0x2C0, 0x3000) for a in ("", "e", "!") for b in ("", "\u0301", "!") if chr(c).isprintable()]
    got = [np.frombuffer(b, "<u4").tolist() for b in packing.chunk_encoder(packing.default_tokenizer())(words)]
    assert [w for w, g in zip(words, got, strict=True) if g != tokenizer.encode(w, add_special_tokens=False).ids] == []
    text = " ".join(words)
    ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
    pieces = packing.packed(docs(spark, [(1, text)])).orderBy("piece").collect()
    assert [(x["start"], x["length"], x["ids_crc32"]) for x in pieces] == [(k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())) for k in range(0, len(ids), 4096)]


def test_local_search_empties_bins():
    # best fit leaves four bins where three hold everything
    lengths = [6, 4, 5, 5, 5, 5]
    bins = packing.local_search([[0], [1, 2], [3, 4], [5]], lengths, 10)
    assert len(bins) == 3 and sorted(i for b in bins for i in b) == list(range(6))
    assert all(sum(lengths[i] for i in b) <= 10 for b in bins)
    r = random.Random(1)
    for _ in range(30):
        lengths = [r.randint(1, 60) for _ in range(60)]
        start = packing.best_fit(lengths, 100)
        end = packing.local_search([list(b) for b in start], lengths, 100)
        assert sorted(i for b in end for i in b) == list(range(60)) and len(end) <= len(start)
        assert all(sum(lengths[i] for i in b) <= 100 for b in end)


def test_local_search_ends_without_a_step():
    r, stuck = random.Random(2), 0
    for k in range(60):
        lengths = [r.choice((r.randint(9, 22), r.randint(1, 30))) if k % 2 else r.randint(12, 19) for _ in range(40)]
        bins = packing.local_search(packing.best_fit(lengths, 40), lengths, 40)
        assert sorted(i for b in bins for i in b) == list(range(40)) and all(sum(lengths[i] for i in b) <= 40 for b in bins)
        if len(bins) == -(-sum(lengths) // 40):
            continue
        stuck += 1
        for a in bins:
            for b in bins:
                fill = sum(lengths[i] for i in b)
                if a is b or fill < sum(lengths[i] for i in a) or fill == 40:
                    continue
                gives = [lengths[i] for i in a] + [lengths[i] + lengths[j] for i in a for j in a if i < j]
                assert all(lengths[i] > 40 - fill for i in a)
                assert not any(0 < g - lengths[t] <= 40 - fill for g in gives for t in b)
    assert stuck


def test_packing_gives_equal_rows_and_an_empty_table_their_place(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "c"), (None, None)]
    got = packing.packed(docs(spark, rows)).collect()
    assert len(got) == 4 and len({x["sequence_id"] for x in got}) == 1
    assert sorted(x["offset"] for x in got) == np.cumsum([0, *[x["length"] for x in sorted(got, key=lambda x: x["offset"])][:-1]]).tolist()
    assert packing.packed(docs(spark, rows).where("false")).count() == 0


# ---- SimHash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in runs]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash_matches_all_pairs(spark):
    r = random.Random(6)
    base = [[f"w{r.randrange(500)}" for _ in range(120)] for _ in range(6)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "One two")]
    for i in range(4, 90):
        words = list(r.choice(base))
        for _ in range(r.randint(0, 4)):
            words[r.randrange(len(words))] = "changed"
        rows.append((i, r.choice((" ", "\n", "\t")).join(words)))
    rows.append((5000, rows[10][1]))
    got = {x["doc_id"]: (x["fingerprint"], x["component_id"]) for x in simhash.near_duplicates(docs(spark, rows)).collect()}
    fp = {i: brute_fingerprint(t) for i, t in rows}
    least = {i: i for i in fp}
    changed = True
    while changed:
        changed = False
        for i in fp:
            for j in fp:
                if (fp[i] ^ fp[j]).bit_count() <= 4 and least[j] < least[i]:
                    least[i], changed = least[j], True
    assert got == {i: (f"{fp[i]:016x}", least[i]) for i in fp}
    kept = simhash.keep_one(docs(spark, rows))
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(set(least.values())) and kept.columns == ["doc_id", "text", "node", "key"]
    assert simhash.near_duplicates(docs(spark, rows).where("false")).count() == 0


@pytest.mark.parametrize("block", [40, 300])
def test_simhash_links_across_blocks(spark, block):
    r = np.random.default_rng(3)
    seeds = r.integers(0, 1 << 63, 120, dtype=np.uint64)
    fps = np.unique(np.concatenate([seeds, *(seeds[:60] ^ np.bitwise_or.reduce([np.uint64(1) << r.integers(0, 64, 60).astype(np.uint64) for _ in range(k)]) for k in (1, 3, 4, 5))]))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    least = np.arange(len(fps))
    while True:
        new = np.where(near, least[None, :], len(fps)).min(axis=1)
        if (new == least).all():
            break
        least = new
    table = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    from tidewell.llm.components import components

    roots = {x["node"]: x["root"] for x in components(simhash.links(table, block=block)).collect()}
    signed = fps.view(np.int64).tolist()
    groups = {}
    for k, x in enumerate(signed):
        groups.setdefault(least[k], set()).add(roots.get(x, x))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)
