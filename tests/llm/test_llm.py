"""Each operator against brute force, an exact round trip or held-out accuracy, with nulls, copies, empty tables and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from heatgraph.llm import credentials, flac, langid, media, mixing, packing, quality, sampling, simhash, substring, toxicity, weaklabel

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (1, "a b c d e f a b c d"), (1, "a b c d e f a b c d"), (2, "x a b c d E"), (None, "a b c d e f g"), (3, None), (4, ""), (-5, "b\tc\n\nd e"),
    (6, "é 漢字 " * 200), (7, "word " * 30_000), (8, "   "), (None, None), (9, "x" * 200_000),
]
DDL = "doc_id long, text string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DDL)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def clashing(df):
    """The same rows with columns named as the operators' own."""
    names = ["secret_spans", "lang_pred", "lang_score", "n_words", "n_bytes", "media", "blocks", "mix_copy", "mix_rate", "mix_order", "toxic_score", "rate", "size", "key", "unit", "fp"]
    return df.withColumns({n: F.lit("own") for n in names})


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


# secret scans

ASSIGN = re.compile(r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secret_base(spark, docs):
    draw = random.Random(5)
    bits = ["token", " = ", '"', "secret:", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", " ", "é", "\n", "pass", "password=", "x" * 7, "api_key", "Api-Key", "=", "漢"]
    made = [(1000 + i, "".join(draw.choice(bits) for _ in range(draw.randrange(60)))) for i in range(300)] + [(5000, "token=abcdef1 " * 500), (None, None), (5001, "")]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(made, DDL))
    found = Counter((r["doc_id"], r["base_sha256"]) for r in credentials.secret_report(rows).collect())
    assert found == Counter((i, hashlib.sha256(base_spans(t).encode()).hexdigest()) for i, t in pairs(rows))


def test_secret_links(spark):
    near = "é login = bob\npwd = hunter2 http://x.y/z"
    rows = spark.createDataFrame([(1, near + "\n\nkey: zzz"), (1, near + "\n\nkey: zzz"), (2, "login = bob"), (3, "login = bob" + " x" * 150 + " pwd = hunter2"), (4, None)], DDL)
    spans = {r["doc_id"]: r["spans"] for r in credentials.secret_report(rows).collect()}
    assert spans == {1: "user:2:13,phrase:14:27,endpoint:28:40", 2: "", 3: "", 4: ""}
    clean = {r["doc_id"]: r["text"] for r in credentials.redact_secrets(clashing(rows)).collect()}
    assert clean == {1: "é [REDACTED]\n[REDACTED] [REDACTED]\n\nkey: zzz", 2: "login = bob", 3: "login = bob" + " x" * 150 + " pwd = hunter2", 4: None}
    assert credentials.secret_report(rows.limit(0)).count() == 0


def test_secret_links_of_long_parts(spark):
    long = "Qz." * 100
    made = [
        (1, f"user=bob token={long}", "user:0:8,assign:9:315", "[REDACTED] [REDACTED]"),
        (2, f"pwd={long} login=x", "phrase:0:304,user:305:312", "[REDACTED] [REDACTED]"),
        (3, f"login=x https://h.io/{long * 4} pwd=y", "endpoint:8:1221,phrase:1222:1227", "login=x [REDACTED] [REDACTED]"),
        (4, f"login=x\n\ntoken={long}", "assign:9:315", "login=x\n\n[REDACTED]"),
        (5, "login=x" + " z" * 101 + f" token={long}", "assign:210:516", "login=x" + " z" * 101 + " [REDACTED]"),
        (6, f"token={long} " + "z " * 90 + "login=x", "assign:0:306,user:487:494", "[REDACTED] " + "z " * 90 + "[REDACTED]"),
    ]
    rows = spark.createDataFrame([m[:2] for m in made], DDL)
    assert {r["doc_id"]: r["spans"] for r in credentials.secret_report(rows).collect()} == {i: x for i, _, x, _ in made}
    assert dict(pairs(credentials.redact_secrets(rows))) == {i: x for i, _, _, x in made}


ROLES = {"assign": True, "hex": True, "phrase": True}
REACH = 200


def all_spans(text):
    """Links by trying all pairs of a text."""
    text = text or ""
    found = [(int(a), k, int(b)) for k, a, b in (x.split(":") for x in base_spans(text).split(",") if x)]
    weak = [(m.start(), k, m.end()) for k, p, _ in credentials.WEAK for m in re.finditer(p, text, re.ASCII)]
    stops = [m.span() for m in re.finditer(r"\n(?:[ \t\r]*\n)+", text)]
    out = list(found)
    for a, k, b in weak:
        lo = max([a - REACH, 0, *(e for _, e in stops if e <= a)])
        hi = min([b + REACH, *(s for s, _ in stops if s >= b)])
        if any((k2 in ROLES) != (k in ROLES) and a2 <= hi and b2 >= lo for a2, k2, b2 in found + weak):
            out.append((a, k, b))
    return sorted(out, key=lambda x: (x[0], credentials.KINDS.index(x[1])))


def masked(text):
    out, at = [], 0
    for a, _, b in all_spans(text):
        if a > at or not out:
            out += [(text or "")[at:a], None]
        at = max(at, b)
    return "".join("[REDACTED]" if x is None else x for x in [*out, (text or "")[at:]]) if text else text


def test_secret_links_against_all_pairs(spark):
    draw = random.Random(7)
    bits = ["login = bob", "user:ann", "pwd = hunter2", "key: 'zz9'", "token=abcdef12", "https://h.io/x?y=1", "host: db.local:5432", "me.33@mail.example.com", "10.0.0.12:80", "AKIA" + "Q" * 16, "deadbeef" * 4,
            "é", "漢字 ", "words of prose, ", "x" * 90 + " ", "z " * 45, "w " * 99, "\n", "\n\n", "\n \t\n", "\r\n", " ", " "]
    made = [(i, "".join(draw.choice(bits) + draw.choice(["", " ", "\n"]) for _ in range(draw.randrange(40)))) for i in range(500)]
    # parts at each side of the reach, copies, and one text with thousands of parts
    made += [(1000 + n, "login = bob" + "é" * n + " pwd = hunter2") for n in range(195, 204)] + [(2000 + n, made[n % 7][1]) for n in range(60)]
    made += [(3000, "".join(draw.choice(bits) + " " for _ in range(4_000))), (3001, "token=abcdef1 " * 20_000), (3002, "a@" * 9000), (None, None), (3003, "")]
    rows = spark.createDataFrame(made, DDL)
    found = credentials.secret_report(rows).collect()
    name = lambda x: ",".join(f"{k}:{a}:{b}" for a, k, b in x)
    assert Counter((r["doc_id"], r["spans"]) for r in found) == Counter((i, name(all_spans(t))) for i, t in made)
    linked = sum(r["spans"].count(k) for r in found for k in ("user", "phrase", "endpoint", "email", "address"))
    assert linked > 1000
    clean = credentials.redact_secrets(clashing(rows))
    assert clean.columns == clashing(rows).columns and {r["secret_spans"] for r in clean.select("secret_spans").collect()} == {"own"}
    assert Counter(pairs(clean)) == Counter((i, masked(t)) for i, t in made)


def test_secrets_of_the_tables_are_linked(spark, sf):
    rows = spark.read.parquet(sf.replace("0.001", "0.1") + "/documents.parquet").filter(F.col("text").contains("="))
    spans = [r["spans"] for r in credentials.secret_report(rows).collect()]
    assert sum("email" in x for x in spans) > 5 and sum("address" in x for x in spans) > 0
    assert spans and all("email" not in x or "assign" in x or "hex" in x for x in spans)


def test_secret_plan_is_native(docs):
    plan = credentials.secret_report(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# language


def test_language(spark, docs, odd):
    found = langid.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r["held_out"]]
    assert len(found) == docs.count() and all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) == r["held_out"] for r in found)
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    langs, prototypes = langid.fit_prototypes(docs)
    rows = langid.predict_language(clashing(odd), langs, prototypes).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) and 0 <= r["lang_score"] <= 1
    none, empty = langid.fit_prototypes(docs.limit(0))
    assert none == [] and {r["lang_pred"] for r in langid.predict_language(odd, none, empty).collect()} == {"und"}


def test_language_stage_rejects_foreign_and_random_texts(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    draw = random.Random(3)
    scripts = ["abcdefghijklmnopqrstuvwxyz", "".join(map(chr, range(0x430, 0x450))), "".join(map(chr, range(0x4E00, 0x5200)))]
    word = lambda letters: "".join(draw.choice(letters) for _ in range(draw.randrange(2, 9)))
    planted = [(10_000_000 + 5000 * k + 1000 * j + i, " ".join(word(x) for _ in range(n))) for k, x in enumerate(scripts) for j, n in enumerate((10, 30, 200, 2000)) for i in range(100 if n < 200 else 20)]
    rows = docs.unionByName(spark.createDataFrame(planted, DDL), allowMissingColumns=True)
    kept = {i for i, _ in pairs(corpus_pipeline.language(spark, rows, sf))}
    known = pairs(docs)
    assert sum(i in kept for i, _ in known) >= 0.985 * len(known)
    assert sum(i in kept for i, _ in planted) <= 0.01 * len(planted)
    # short texts score low and still pass
    short = [(20_000_000 + i, " ".join(t.split()[5:10])) for i, t in known if t and len(t.split()) > 100][:300]
    rows = docs.unionByName(spark.createDataFrame(short, DDL), allowMissingColumns=True)
    kept = {i for i, _ in pairs(corpus_pipeline.language(spark, rows, sf))}
    assert sum(i in kept for i, _ in short) >= 0.95 * len(short)
    assert corpus_pipeline.language(spark, docs.limit(0), sf).count() == 0


def test_many_languages_and_long_texts(spark):
    draw = np.random.default_rng(5)
    vectors, prototypes = (langid._unit(draw.normal(size=(n, 64))) for n in (30, 2500))
    prototypes[7] = prototypes[2400]
    best, value = langid.nearest(vectors, prototypes, 100)
    cosines = np.clip(vectors @ prototypes.T, 0, 1)
    assert (best == cosines.argmax(1)).all() and np.allclose(value, cosines.max(1))
    train = spark.createDataFrame([(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} {chr(0x4E00 + i)}{chr(0x4E00 + i)}", f"lang{i:04d}") for i in range(2001)], "text string, lang string")
    langs, table = langid.fit_prototypes(train, langid.Space(64))
    assert len(langs) == len(table) == 2001
    space = langid.Space(64)
    text = "Él dijo: ¿qué? 123 " * 40 + "漢字 x"
    whole, parts = langid.bundle([text], space), langid.bundle([text], space, 37)
    assert (whole[0] == parts[0]).all() and whole[1] == parts[1]
    assert not langid.bundle(["1 2 " * 50], space, 37)[1][0]


def test_prototypes_and_cosines_by_hand(spark):
    space = langid.Space(dims=128)
    texts = [("el perro come", "es"), ("el perro come", "es"), ("la casa roja", "es"), ("the dog eats", "en"), ("a red house", "en"), (None, "en"), ("x", None)]
    langs, table = langid.fit_prototypes(spark.createDataFrame(texts, "text string, lang string"), space)
    vector = lambda t: (lambda x: x / np.linalg.norm(x))(sum(np.prod([np.roll(langid._letter(space, ord(c)).astype(int), 2 - k) for k, c in enumerate(f" {t} "[i : i + 3])], 0) for i in range(len(t))))
    want = [sum(vector(t) for t in {t for t, k in texts if k == lang and t}) for lang in ("en", "es")]
    assert langs == ["en", "es"] and np.allclose(table, [w / np.linalg.norm(w) for w in want], atol=1e-5)
    rows = langid.predict_language(spark.createDataFrame([("red dog",)], "text string"), langs, table, space).collect()
    cosines = [float(vector("red dog") @ (w / np.linalg.norm(w))) for w in want]
    assert rows[0]["lang_pred"] == langs[int(np.argmax(cosines))] and abs(rows[0]["lang_score"] - max(cosines)) < 1e-5


def test_the_pipeline_learns_languages_from_all_texts(spark, monkeypatch):
    import corpus_pipeline

    draw = random.Random(3)
    texts = {" ".join(draw.choice("abcdefgh") * draw.randint(1, 3) + draw.choice("ij") for _ in range(draw.randint(2, 9))) for _ in range(9_000)}
    rows = [(i, t, "xx") for i, t in enumerate([*sorted(texts), *["aaaj bbi"] * 3_000])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = {}
    keep = lambda docs, langs, prototypes, spread: seen.update(table=prototypes, spread=spread.first()["spread"]) or docs
    monkeypatch.setattr(langid, "keep_known", keep)
    corpus_pipeline.language(spark, docs, "")
    train = sorted({t for i, t, _ in rows if zlib.crc32(str(i).encode()) % 5})
    vectors = langid._unit(langid.bundle(train, langid.Space())[0])
    table = langid._unit(np.rint(vectors * langid._SCALE).sum(0, np.float64))
    assert np.allclose(seen["table"][0], table, atol=1e-6)
    n, s = np.array([sum(map(str.isalpha, t)) for t in train]), np.clip(vectors @ table, 0, 1)
    wide = np.sort(n * (1 / s**2 - 1))
    assert len(train) > 6_000 and wide[len(wide) // 2 - 3] - 1e-3 <= seen["spread"] <= wide[len(wide) // 2 + 3] + 1e-3


def test_hyperdimensional_sums_by_hand():
    space = langid.Space(dims=64)
    a, b, blank = (langid._letter(space, ord(c)).astype(int) for c in "ab ")
    want = np.roll(blank, 2) * np.roll(a, 1) * b + np.roll(a, 2) * np.roll(b, 1) * blank
    got, has = langid.bundle(["1AB!", "", None], space)
    assert (got[0] == want).all() and not got[1:].any() and has.tolist() == [True, False, False]


# packing


def check_packed(rows, found):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [(i, library.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in rows]
    pool = defaultdict(list)
    for r in found:
        pool[r["doc_id"], r["doc_tokens"]].append(r)
    for (i, n), own in pool.items():
        docs_of = [x for k, x in ids if k == i and len(x) == n]
        assert sorted((r["start"], r["length"]) for r in own) and sum(r["length"] for r in own) == n * len(docs_of)
        for r in own:
            assert r["ids_crc32"] in {zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for x in docs_of}
    assert sum(r["length"] for r in found) == sum(len(x) for _, x in ids)
    places = defaultdict(list)
    for r in found:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        own.sort()
        ends = np.cumsum([n for _, n in own])
        assert [a for a, _ in own] == [0, *ends[:-1]] and (ends[-1] == 2048 or ends[-1] & (ends[-1] - 1) == 0)


def test_packing(spark, docs, odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    check_packed(pairs(docs), packing.pack_documents(docs, path).collect())
    made = [(1, "a  b \n c  "), (2, " x  y  　 z "), (5, "don't it's  'll\n\n  q"), (6, "<|endoftext|> x"), (8, " \x1c a\x85b")]
    rows = odd.unionByName(spark.createDataFrame(made, DDL))
    check_packed(pairs(rows), packing.pack_documents(clashing(rows), path).collect())
    assert packing.pack_documents(odd.limit(0), path).count() == 0


def test_whole_examples(spark):
    draw = random.Random(2)
    rows = [(i, draw.randrange(1, 1500), draw.randrange(0, 800)) for i in range(400)] + [(900, 0, 0), (901, 5000, 1), (902, None, None)]
    examples = spark.createDataFrame(rows, "example_id long, tokens long, loss_tokens long")
    limits = packing.Limits(2048, 4, 900)
    found = packing.pack_examples(examples, limits).join(examples, "example_id").collect()
    by = defaultdict(list)
    for r in found:
        if r["sequence_id"] is not None:
            by[r["sequence_id"]].append((r["offset"], r["tokens"], min(r["loss_tokens"], r["tokens"])))
    assert len(found) == len(rows) and sum(map(len, by.values())) == 400
    for own in by.values():
        own.sort()
        assert [a for a, _, _ in own] == [0, *np.cumsum([n for _, n, _ in own])[:-1]]
        assert sum(n for _, n, _ in own) <= 2048 and len(own) <= 4 and sum(x for _, _, x in own) <= 900


def filled(pieces):
    """The share of tokens that aren't padding: sequences are padded to 2048, except at a power of two."""
    size = Counter()
    for r in pieces:
        size[r["sequence_id"]] += r["length"]
    return sum(size.values()) / sum(n if n & (n - 1) == 0 else 2048 for n in size.values())


@pytest.mark.parametrize("words", [1, 2, 3, 40])
def test_short_texts_need_no_padding(spark, words):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit(" a"), words).alias("text"))
    found = packing.pack_documents(rows, public_tokenizers.path("byte_bpe_50k.json")).collect()
    segments = Counter(r["sequence_id"] for r in found)
    assert max(segments.values()) <= 128 and sum(r["length"] for r in found) == 6000 * found[0]["doc_tokens"] and filled(found) == 1


def test_packer_follows_the_dot_product():
    draw = random.Random(6)
    limits = packing.Limits(100, 5, 40)
    packer = packing.Packer(limits, 4, cut=False)
    open_, done = [], []  # the same by hand: lists of (tokens, loss)
    room = lambda s: (100 - sum(n for n, _ in s), 5 - len(s), 40 - sum(m for _, m in s))
    for k in range(500):
        n = draw.randrange(1, 60)
        m = draw.randrange(0, min(n, 30))
        packer.add(packing.Piece(k, 0, n, m))
        while True:
            fits = [(sum(a * b / c / c for a, b, c in zip(room(s), (n, 1, m), (100, 5, 40), strict=True)), -i) for i, s in enumerate(open_) if all(a >= b for a, b in zip(room(s), (n, 1, m), strict=True))]
            if fits or len(open_) < 4:
                if not fits:
                    open_.append([])
                i = -max(fits)[1] if fits else len(open_) - 1
                open_[i].append((n, m))
                if room(open_[i])[0] == 0:
                    done.append(open_.pop(i))
                break
            done.append(open_.pop(min(range(len(open_)), key=lambda i: room(open_[i])[0])))
    shape = lambda seqs: [[(p.length, p.loss) for p in s] for s in seqs]
    assert shape(packer.done) == done and shape(packer.open) == open_


def test_pieces_keep_all_limits():
    draw = random.Random(9)
    limits = packing.Limits(256, 6, 90)
    packer, total = packing.Packer(limits, 5), 0
    for k in range(800):
        n = draw.randrange(1, 700 if k % 9 == 0 else 40)
        packer.add(packing.Piece(k, 0, n, draw.randrange(0, n + 1)))
        total += n
    packer.finish()
    for seq in packer.done:
        n = sum(p.length for p in seq)
        assert n <= 256 and n & (n - 1) == 0 and len(seq) <= 6 and sum(p.loss for p in seq) <= 90
    assert sum(p.length for s in packer.done for p in s) == total


def test_conversations_keep_three_limits(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    turns = turns.unionByName(spark.createDataFrame([(10**6, 0, None, None), (10**6, 1, "assistant", "x " * 5000), (None, 0, "user", "")], turns.schema))
    path, limits = public_tokenizers.path("byte_bpe_50k.json"), packing.Limits(2048, 32, 512)
    library, want = Tokenizer.from_file(path), {}
    for r in turns.collect():
        n = len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1
        a, b = want.get(r["conv_id"], (0, 0))
        want[r["conv_id"]] = (a + n, b + n * (r["role"] == "assistant"))
    found = packing.pack_conversations(clashing(turns), path, limits).collect()
    assert {r["conv_id"]: (r["tokens"], r["loss_tokens"]) for r in found} == want and len(found) == len(want)
    by = defaultdict(list)
    for r in found:
        assert (r["sequence_id"] is None) == (r["tokens"] > 2048 or r["loss_tokens"] > 512)
        if r["sequence_id"] is not None:
            by[r["sequence_id"]].append((r["offset"], r["tokens"], r["loss_tokens"]))
    for own in by.values():
        assert sum(n for _, n, _ in own) <= 2048 and len(own) <= 32 and sum(m for _, _, m in own) <= 512
    assert packing.pack_conversations(turns.limit(0), path).count() == 0


# quality rules


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(grams)
    covered = {j for i, g in enumerate(grams) if times[g] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def test_quality_counts(spark, docs, odd):
    draw = random.Random(1)
    made = [(i, "".join(draw.choice(["a ", "b ", "c\n", "# ", "é", "\t", "a b c d e f g h "]) for _ in range(draw.randrange(80)))) for i in range(200)]
    for rows in (docs.select("doc_id", "text"), odd, spark.createDataFrame(made, DDL)):
        found = quality.quality_report(rows.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s")})).collect()
        assert ordered((r["doc_id"], *(r[c] for c in quality.COUNTS[:5])) for r in found) == ordered((i, *counts(t)) for i, t in pairs(rows))
        for r in found:
            assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["base_failed"] and r["kept"])


def test_quality_keeps_clean_documents(spark, sf):
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    labels = spark.read.parquet(sf.replace("0.001", "0.01") + "/labels.parquet")
    found = quality.quality_report(docs).join(labels, "doc_id").filter("not base_failed").collect()
    good, bad = ([r["kept"] for r in found if r["quality"] == q] for q in (1, 0))
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.1


def test_sketches_merge(docs):
    counted = quality.with_counts(clashing(docs), ["doc_id", "lang", "source"])
    whole = ordered(quality.sketch(counted).collect())
    halves = quality.sketch(counted.filter("doc_id % 2 = 0")).unionByName(quality.sketch(counted.filter("doc_id % 2 = 1")))
    merged = halves.groupBy("lang", "source", "rate", "bucket").agg(F.sum("n").alias("n"))
    assert ordered(merged.collect()) == whole


def made_groups():
    """Three sources whose texts have few, some and many punctuation marks, and one that is mostly copies."""
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(draw.randrange(3, 9)))
    text = lambda share: " ".join(word() + ("," if draw.random() < share * draw.uniform(0.7, 1.3) else "") for _ in range(draw.randrange(80, 200)))
    out = [(text(share), source) for source, share in (("few", 0.05), ("some", 0.2), ("many", 0.9)) for _ in range(400)]
    copy = text(0.2)
    return out + [(copy, "copies")] * 700 + [(text(0.2), "copies") for _ in range(300)]


def test_quality_thresholds_follow_the_groups(spark):
    made = made_groups()
    odd = ", ".join(re.sub(",", "", made[0][0]).split()) + ","
    rows = [(i, t, "x", s) for i, (t, s) in enumerate(made)] + [(10_000 + k, odd, "x", s) for k, s in enumerate(("few", "some", "many"))]
    found = {r["doc_id"]: r["kept"] for r in quality.quality_report(spark.createDataFrame(rows, DDL + ", lang string, source string")).collect()}
    # one text, three verdicts: what is odd in one source is usual in another
    assert [found[10_000 + k] for k in range(3)] == [False, False, True]
    assert sum(not found[i] for i in range(len(made))) <= 3
    # without the sketch of its group its verdict there is another one
    mixed = [(i, t, "x", None) for i, t, _, _ in rows]
    alone = {r["doc_id"]: r["kept"] for r in quality.quality_report(spark.createDataFrame(mixed, DDL + ", lang string, source string")).collect()}
    assert [alone[10_000 + k] for k in range(3)] == [False] * 3


def test_quality_thresholds_by_hand(spark, sf):
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    rules = quality.Rules()
    rows = quality.with_counts(docs, ["lang", "source"]).collect()
    values = {k: defaultdict(list) for k, *_ in quality.RATES}
    for r in rows:
        for k, a, b in quality.RATES:
            v = int(np.ceil(np.log((r[a] + 1) / (r[b] + 1)) / np.log(rules.gamma)))
            for key in ((r["lang"], r["source"]), (r["lang"],), ()):
                values[k][key].append(v)
    quartile = lambda x, q: sorted(x)[int(np.ceil(q * len(x))) - 1]
    counted = quality.with_counts(docs, ["lang", "source"])
    for r in quality.thresholds(quality.sketch(counted)).collect():
        for k, *_ in quality.RATES:
            levels = [values[k][key] for key in ((r["lang"], r["source"]), (r["lang"],), ())]
            enough = [x for x in levels[:2] if len(x) >= rules.least_rows] + levels[2:]
            spread = max(quartile(x, 0.75) - quartile(x, 0.25) for x in enough)
            assert r[f"most_{k}"] == quartile(enough[0], 0.75) + rules.reach * spread


# media


def payload(text):
    data = (text or "").encode()
    return data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))


def test_media(docs, odd):
    for rows in (docs, odd, clashing(odd)):
        found = media.media_report(rows).collect()
        want = [(i, len((t or "").encode()), len(p := payload(t)), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])) for i, t in pairs(rows)]
        assert ordered(tuple(r)[:5] for r in found) == ordered(want)
    assert media.media_report(odd.limit(0)).count() == 0
    stored = media.store_media(odd.filter("doc_id = 9"))
    (block,) = media.seek(stored, 100_000).collect()
    assert block["sample_offset"] <= 100_000 < block["sample_offset"] + len(block["pcm"]) == block["sample_offset"] + 16 * 576
    assert media.seek(clashing(stored.withColumnRenamed("media", "m")), 10**9, "m").count() == 0
    assert media.seek(clashing(odd).select("*", F.lit(None).cast("binary").alias("m")), 0, "m").count() == 0
    assert block["pcm"] == payload("x" * 200_000)[block["sample_offset"] :][: len(block["pcm"])]


class Bits:
    """A writer for streams that the encoder doesn't make."""

    def __init__(self):
        self.n, self.v = 0, 0

    def put(self, value, bits):
        self.v, self.n = self.v << bits | value & (1 << bits) - 1, self.n + bits

    def bytes(self):
        pad = -self.n % 8
        return (self.v << pad).to_bytes((self.n + pad) // 8, "big")


def crc(data, poly, bits):
    c = 0
    for b in data:
        c ^= b << bits - 8
        for _ in range(8):
            c = (c << 1 ^ poly if c >> bits - 1 & 1 else c << 1) & (1 << bits) - 1
    return c


def frame(number, samples, bps, body):
    head = bytes([0xFF, 0xF8, 7 << 4, {8: 1, 16: 4}[bps] << 1, number]) + (len(samples) - 1).to_bytes(2, "big")
    data = head + bytes([crc(head, 7, 8)])
    w = Bits()
    body(w, samples)
    data += w.bytes()
    return data + crc(data, 0x8005, 16).to_bytes(2, "big")


def rice(w, residual, order, size, partitions, k):
    w.put(0, 2)
    w.put(partitions, 4)
    part = size >> partitions
    for p in range(1 << partitions):
        own = residual[max(0, p * part - order) : (p + 1) * part - order]
        if p == 1:  # an escaped partition
            w.put(15, 4)
            w.put(12, 5)
            for e in own:
                w.put(e, 12)
            continue
        w.put(k, 4)
        for e in own:
            u = 2 * e if e >= 0 else -2 * e - 1
            w.put(1, (u >> k) + 1)
            w.put(u, k)


def linear(w, s):
    weights, shift, order = [3, -2, 1], 1, 3
    w.put(0b0100010 << 1 >> 1, 7)
    w.put(0, 1)
    for x in s[:order]:
        w.put(x, 16)
    w.put(4, 4)
    w.put(shift, 5)
    for c in weights:
        w.put(c, 5)
    rice(w, [s[i] - (sum(c * s[i - 1 - j] for j, c in enumerate(weights)) >> shift) for i in range(order, len(s))], order, len(s), 2, 5)


def fixed(w, s):
    w.put(0b0001100, 7)
    w.put(1, 1)
    w.put(1, 2)  # two wasted bits
    s = [x >> 2 for x in s]
    for x in s[:4]:
        w.put(x, 14)
    rice(w, [s[i] - 4 * s[i - 1] + 6 * s[i - 2] - 4 * s[i - 3] + s[i - 4] for i in range(4, len(s))], 4, len(s), 0, 6)


def bare(w, s):
    w.put(0b0000001, 7)
    w.put(0, 1)
    for x in s:
        w.put(x, 16)


def test_flac_decoder_knows_the_format():
    draw = random.Random(8)
    wave = [int(200 * np.sin(i / 9)) + draw.randrange(-3, 4) for i in range(480)]
    blocks = [(wave[:160], linear), ([4 * x for x in wave[160:320]], fixed), (wave[320:400], bare), ([7] * 64, lambda w, s: (w.put(0, 8), w.put(7, 16)))]
    body = b"".join(frame(i, s, 16, f) for i, (s, f) in enumerate(blocks))
    samples = [x for s, _ in blocks for x in s]
    signed = np.array(samples, "<i2").tobytes()
    info = (160).to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | 15 << 36 | len(samples)).to_bytes(8, "big") + hashlib.md5(signed).digest()
    stream = b"fLaC\x80" + len(info).to_bytes(3, "big") + info + body
    (found,) = flac.decode([stream])
    assert found["samples"].tolist() == samples and found["offsets"].tolist() == [0, 160, 320, 400]
    for at in (len(stream) - 1, len(stream) - 40, 60):
        broken = bytearray(stream)
        broken[at] ^= 4
        with pytest.raises(flac.FlacError):
            flac.decode([bytes(broken)])


def test_seek_reads_one_stretch_at_any_width(spark):
    draw = random.Random(3)
    wave = [int(9000 * np.sin(i / 31)) + draw.randrange(-9, 10) for i in range(64 * 40)]
    frames = [frame(i, wave[64 * i : 64 * i + 64], 16, bare) for i in range(40)]
    at = np.cumsum([0, *map(len, frames)])
    points = b"".join((64 * i).to_bytes(8, "big") + int(at[i]).to_bytes(8, "big") + (64).to_bytes(2, "big") for i in range(0, 40, 8)) + b"\xff" * 18
    info = (64).to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | 15 << 36 | len(wave)).to_bytes(8, "big") + hashlib.md5(np.array(wave, "<i2").tobytes()).digest()
    head = b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points
    stream = head + b"".join(frames)
    # a fault in another stretch doesn't matter, one in the wanted stretch does
    broken = lambda i: bytes(b ^ (4 if k == len(head) + at[i] + 30 else 0) for k, b in enumerate(stream))
    stored = spark.createDataFrame([(1, stream), (2, broken(3)), (3, None)], "doc_id long, media binary")
    for sample in (0, 1000, 1023, 1024, 2559):
        found = media.seek(stored.filter("doc_id <> 2") if sample < 512 else stored, sample).collect()
        first = sample // 512 * 512
        assert len(found) == (1 if sample < 512 else 2)
        for r in found:
            assert r["sample_offset"] == first and r["byte_offset"] == at[first // 64] and r["pcm"] == np.array(wave[first : first + 512], "<i2").tobytes()
    with pytest.raises(flac.FlacError):
        flac.decode_at(broken(16), 1024)
    assert flac.decode_at(stream, 2560) is None


def test_stored_streams_use_linear_prediction(docs, monkeypatch):
    draw = np.random.default_rng(2)
    wave = (128 + 90 * np.sin(np.arange(576 * 40) / 3.1) + 20 * np.sin(np.arange(576 * 40) / 0.7) + draw.normal(0, 1.5, 576 * 40)).astype(np.uint8)
    texts = np.frombuffer(b"".join(payload(t) for _, t in pairs(docs)[:60]), np.uint8)
    kinds = []
    known = flac._subframes
    monkeypatch.setattr(flac, "_subframes", lambda r, at, size, bits: (kinds.extend((r.bits(at, np.full(len(at), 8)) >> 1 & 63).tolist()), known(r, at, size, bits))[1])
    for raw, share in ((wave, 0.9), (texts, 0.02)):
        kinds.clear()
        (stream,) = flac.encode(raw, np.array([len(raw) // 576]))
        (found,) = flac.decode([stream])
        assert ((found["samples"] + 128).astype(np.uint8) == raw).all()
        assert np.mean([k >= 32 for k in kinds]) > share


def test_groups_of_frames_join(monkeypatch):
    monkeypatch.setattr(flac, "_GROUP", 7)
    test_flac_round_trip()
    test_flac_decoder_knows_the_format()


def test_flac_round_trip():
    draw = np.random.default_rng(1)
    streams = [draw.bytes(576 * 5), b"a" * 576, bytes(range(256)) * 9 + b"b" * 576 * 7, b"\xff\xf8\x24\x02\x00" * 2880, b"word " * 576 * 150]
    coded = flac.encode(np.frombuffer(b"".join(streams), np.uint8), np.array([len(s) // 576 for s in streams]))
    assert [(d["samples"] + 128).astype(np.uint8).tobytes() for d in flac.decode(coded)] == streams


# mixing


def test_mixing(spark, docs, odd):
    rows = docs.select("doc_id", "text", "source")
    sizes = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect()}
    total, want = sum(sizes.values()), Counter()
    unit = lambda what, key: int(hashlib.md5(f"11|{what}|{key}".encode()).hexdigest()[:13], 16) / 2**52
    for r in rows.collect():
        rate = total / len(sizes) / sizes[r["source"]]
        u = unit("n", f"{r['doc_id']}:{hashlib.md5(r['text'].encode()).hexdigest()}")
        p = acc = np.exp(-rate)
        k = 0
        while acc <= u:
            k += 1
            p *= rate / k
            acc += p
        want[r["doc_id"]] = k
    found = mixing.mix_sources(rows).collect()
    assert Counter(r["doc_id"] for r in found) == +want
    some = mixing.mix_sources(clashing(odd.withColumn("source", F.when(F.col("doc_id") > 3, "s"))), {"s": 1.0}, 3.0).collect()
    assert {r["source"] for r in some} <= {"s", None} and all(r["mix_copy"] >= 1 for r in some)
    assert mixing.mix_sources(rows.limit(0)).count() == 0
    with pytest.raises(ValueError, match="repeated"):
        mixing.mix_sources(rows, {"src1": 1.0}, 1000.0)


def test_rare_sources_are_mixed_whole(spark):
    rows = [(i, "word " * 200, "big") for i in range(100)] + [(1000, "y" * 30, "rare"), (1001, "x" * 2, None)]
    total = sum(len(t) for _, t, _ in rows)
    want = {}
    for i, text, s in rows:
        rate = total / 3 / sum(len(t) for _, t, o in rows if o == s)
        k = np.arange(int(rate + 12 * rate**0.5 + 24))
        logs = k * np.log(rate) - rate - np.concatenate([[0], np.cumsum(np.log(k[1:]))])
        u = int(hashlib.md5(f"11|n|{i}:{hashlib.md5(text.encode()).hexdigest()}".encode()).hexdigest()[:13], 16) / 2**52
        want[i] = int(np.searchsorted(np.cumsum(np.exp(logs)), u, side="right"))
    found = mixing.mix_sources(spark.createDataFrame(rows, DDL + ", source string")).collect()
    assert Counter(r["doc_id"] for r in found) == +Counter(want) and want[1000] > 256 and want[1001] > 4096
    copies = sorted(r["mix_copy"] for r in found if r["doc_id"] == 1001)
    assert copies == list(range(1, want[1001] + 1))


def test_poisson_moments(spark):
    found = spark.range(20_000).select(mixing.poisson(mixing.uniform(1, "t", F.col("id").cast("string")), F.lit(2.5)).alias("k")).agg(F.avg("k"), F.variance("k")).first()
    assert abs(found[0] - 2.5) < 0.05 and abs(found[1] - 2.5) < 0.12


# weak labels


def test_weak_labels_recover_accuracies():
    draw = np.random.default_rng(0)
    truth = draw.random(40_000) < 0.8
    votes = []
    for right, speaks in ((0.9, 0.8), (0.7, 0.9), (0.95, 0.5), (0.6, 1.0), (0.85, 0.7), (0.8, 0.6), (0.75, 0.8), (0.9, 0.9)):
        v = np.where(draw.random(len(truth)) < right, truth, ~truth) * 2 - 1
        votes.append(np.where(draw.random(len(truth)) < speaks, v, 0))
    patterns, times = np.unique(np.stack(votes, 1), axis=0, return_counts=True)
    model = weaklabel.estimate(patterns, times.astype(float))
    assert abs(model.prior - 0.8) < 0.03
    assert np.allclose(list(model.accuracies().values()), [0.9, 0.7, 0.95, 0.6, 0.85, 0.8, 0.75, 0.9], atol=0.04)


def test_patterns_against_counts_by_hand(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(150)
    rows, want = [r["text"] or "" for r in docs.collect()], Counter()
    for t in rows:
        n_words, chars, symbols, dup, repeats = counts(t)
        words = WORD.findall(t)
        lines = sum(bool(WORD.search(x)) for x in t.split("\n"))
        share = [symbols / max(1, n_words), sum(33 <= ord(c) < 127 and not c.isalnum() for c in t) / max(40, chars), sum("A" <= c <= "Z" for c in t) / max(40, chars),
                 dup / max(1, lines), repeats / max(1, n_words), sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, n_words)]
        v = [-1 if x > high else 0 for x, high in zip(share, weaklabel.BANDS.values(), strict=True)]
        size = chars / max(1, n_words)
        want[*v, 1 if n_words >= 50 else -1 if n_words < 1 else 0, 1 if 3.5 <= size <= 9 else -1 if not 2 <= size <= 16 else 0] += 1
    found = quality.with_counts(docs, []).groupBy(weaklabel.votes().alias("v")).count().collect()
    assert {tuple(r["v"]): r["count"] for r in found} == want


def test_expectation_maximisation_by_dictionaries():
    draw = random.Random(3)
    rows = [tuple(draw.choice((-1, 0, 0, 1)) for _ in range(8)) for _ in range(60)]
    times = [draw.randrange(1, 30) for _ in rows]
    model = weaklabel.estimate(np.array(rows), np.array(times, float), rounds=5)
    prior, table = 0.8, {(c, j, v): p for c, row in enumerate(([0.3, 0.6, 0.1], [0.02, 0.68, 0.3])) for j in range(8) for v, p in zip((-1, 0, 1), row, strict=True)}
    start = dict(table)
    for _ in range(5):
        good = []
        for r in rows:
            a, b = 1 - prior, prior
            for j, v in enumerate(r):
                a, b = a * table[0, j, v], b * table[1, j, v]
            good.append(b / (a + b))
        for c in range(2):
            for j in range(8):
                n = {v: sum(t * (g if c else 1 - g) for r, t, g in zip(rows, times, good, strict=True) if r[j] == v) + start[c, j, v] for v in (-1, 0, 1)}
                table |= {(c, j, v): x / sum(n.values()) for v, x in n.items()}
        prior = (sum(t * g for t, g in zip(times, good, strict=True)) + 0.8) / (sum(times) + 1)
    assert abs(model.prior - prior) < 1e-9
    assert all(abs(model.table[c, j, v + 1] - p) < 1e-9 for (c, j, v), p in table.items())


def test_shape_features_and_fit_by_hand():
    text = b"ab AB1, ab ab"
    shape = "a A0, a a"
    want = np.zeros(weaklabel.DIMS)
    grams = [shape[i : i + n] for n in range(1, 5) for i in range(len(shape) - n + 1)]
    for g in grams:
        key = 0
        for c in g.encode():
            key = key << 8 | c
        want[((key + (len(g) << 40)) * 0x9E3779B97F4A7C15 % 2**64) >> 54] += 1 / len(grams)
    want[0] += 1 / 4  # "ab ab"
    assert np.allclose(weaklabel.features(np.frombuffer(text, np.uint8)) ** 2, want)
    draw = np.random.default_rng(1)
    x = draw.random((300, 6)).astype(np.float32)
    y = 1 / (1 + np.exp(-(x @ np.array([4.0, -3, 2, 0, 0, 1]) - 1)))
    times = draw.integers(1, 5, 300)
    fit = weaklabel.fit_logistic(x, y, times)
    again = weaklabel.fit_logistic(np.repeat(x, times, 0), np.repeat(y, times), np.ones(times.sum()))
    p = 1 / (1 + np.exp(-(x @ fit.weights + fit.bias)))
    assert np.abs(p - y).max() < 0.02 and np.allclose(fit.weights, again.weights, atol=1e-2)


def test_samples_are_bounded_by_distinct_texts(spark):
    rows = spark.createDataFrame([("copy",)] * 900 + [(None,)] * 900 + [(f"text {i}",) for i in range(900)], "text string")
    found = sampling.sample_texts(rows, 100).collect()
    assert 60 <= len(found) <= 140
    every = {r["text"]: r["times"] for r in sampling.sample_texts(rows, 10_000).collect()}
    assert len(every) == 902 and every["copy"] == every[None] == 900
    by = sampling.sample_texts(rows.select("text", F.coalesce(F.length("text") > 5, F.lit(False)).alias("k")), 50, ["k"]).groupBy("k").count().collect()
    assert {r["k"] for r in by} == {True, False} and max(r["count"] for r in by) < 90
    assert sampling.sample_texts(rows.limit(0), 5).count() == 0
    # a third of all rows without a text, and a third copies: one row each comes to the driver
    docs = rows.withColumn("doc_id", F.monotonically_increasing_id())
    model = weaklabel.fit_labellers(quality.with_counts(docs, []))
    scorer = weaklabel.fit_scorer(docs, model, 50)
    assert np.isfinite(scorer.weights).all()


def test_weak_label_report(spark, sf, odd):
    big = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    found = weaklabel.weak_label_report(docs).join(labels, "doc_id").collect()
    assert np.mean([r["kept"] for r in found if r["quality"] == 1]) > 0.97
    assert np.mean([r["kept"] for r in found if r["quality"] == 0]) < 0.5
    rows = weaklabel.weak_label_report(clashing(odd)).collect()
    assert len(rows) == len(ODD) and len({str(tuple(r)) for r in rows if r["doc_id"] == 1}) == 1
    assert weaklabel.weak_label_report(odd.limit(0)).count() == 0


# toxicity


def test_toxicity(spark, sf, odd):
    big = sf.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    some = docs.join(F.broadcast(labels.select("doc_id")), "doc_id", "left_semi")
    found = toxicity.toxicity_report(some, labels).join(labels, "doc_id").filter("held_out").collect()
    hit = [r["predicted"] for r in found if r["toxic"] == 1]
    assert np.mean(hit) > 0.75 and np.mean([r["predicted"] for r in found if r["toxic"] == 0]) < 0.02
    rows = toxicity.toxicity_report(clashing(odd), labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.toxicity_report(odd, labels.limit(0)).count() == len(ODD) and toxicity.toxicity_report(odd.limit(0), labels).count() == 0


def grams_of(text, grams):
    """The distinct n-grams of a text, as strings."""
    words = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
    line = " " + "".join(w + " " for w in words)
    return {line[i : i + n] for n in range(grams.least, grams.most + 1) for i in range(len(line) - n + 1)}


def test_features_are_characters_of_any_script():
    grams = toxicity.Grams(3, 5, 22)
    scratch = np.zeros(1 << grams.bits, np.int32)
    for text in ("Idiot, idiot", "ÉTÉ à l'été", "漢字かな交じり文 漢字", "ДА да", "", " ", "a"):
        found = toxicity.present(text, grams, scratch)
        assert len(found) == len(set(found.tolist())) == len(grams_of(text, grams))
    assert set(toxicity.present("ÉTÉ", grams, scratch).tolist()) == set(toxicity.present("été", grams, scratch).tolist())
    long = " ".join(f"wort{i}ß" for i in range(3000))
    assert set(toxicity.present(long, grams, scratch, 500).tolist()) >= set(toxicity.present(long, grams, scratch).tolist())


def test_ratios_against_a_naive_count(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.labelled(docs, labels)
    grams = toxicity.Grams(3, 4, 24)
    counts, n = toxicity.count_grams(rows, grams)
    seen, total = (Counter(), Counter()), [0, 0]
    for r in rows.collect():
        total[r["toxic"]] += 1
        seen[r["toxic"]].update(grams_of(r["text"], grams))
    assert n.tolist() == total and min(total) > 0
    every = set(seen[0]) | set(seen[1])
    scratch = np.zeros(1 << grams.bits, np.int32)
    size = 1 << grams.bits
    p, q = (sum(c.values()) + size for c in (seen[1], seen[0]))
    ratio, alone = toxicity.log_ratios(counts), 0
    for g in list(every)[:3000]:
        (f,) = [x for x in toxicity.present(g, grams, scratch).tolist() if counts[:, x].tolist() == [seen[0][g], seen[1][g]]][:1] or [None]
        if f is None or g[0] == " " or g[-1] == " ":
            continue  # shares its feature with another gram, or isn't a text's inner gram
        alone += 1
        want = np.log((seen[1][g] + 1) / p) - np.log((seen[0][g] + 1) / q)
        assert abs(ratio[f] - want) < 1e-3
    assert alone > 500


def test_every_occurring_feature_is_fitted():
    draw = np.random.default_rng(4)
    # 5,000 features: one tells, it is the rarest of all
    sets, y = [], []
    for k in range(600):
        toxic = k % 10 == 0
        sets.append(np.unique(np.append(draw.integers(0, 4999, 60), [4999] if toxic else [])).astype(np.uint32))
        y.append(float(toxic))
    counts = np.zeros((2, 5000), np.int64)
    for s, t in zip(sets, y, strict=True):
        counts[int(t), s.astype(int)] += 1
    ratio = toxicity.log_ratios(counts)
    small = [toxicity.packed(s) for s in sets]
    assert all((toxicity.unpacked(x) == s).all() for x, s in zip(small, sets, strict=True))
    assert toxicity.unpacked(toxicity.packed(np.array([0, 254, 255, 510, 2000]))).tolist() == [0, 254, 255, 510, 2000] and not len(toxicity.unpacked(toxicity.packed(np.zeros(0, int))))
    w, bias = toxicity.fit_logistic(small, np.array(y), ratio, np.ones(600))
    z = np.array([(w * ratio)[s.astype(int)].sum() for s in sets]) + bias
    assert ((z > 0) == np.array(y, bool)).all() and np.argmax(w * ratio) == 4999
    # a row that counts three times is three rows
    a = toxicity.fit_logistic(small[:200], np.array(y[:200]), ratio, np.full(200, 3.0))
    b = toxicity.fit_logistic(small[:200], np.array(y[:200]), ratio, np.ones(200))
    assert np.allclose(a[0], b[0])


def test_labels_are_bounded(spark):
    docs = spark.createDataFrame([(i, f"text {i}", 7) for i in range(50)] + [(3, "text again", 7)], DDL + ", toxic int")
    labels = spark.createDataFrame([(i % 50, i % 2, "x") for i in range(5000)] + [(1, 0, "x"), (None, 1, "x"), (2, None, "x")], "doc_id long, toxic int, text string")
    found = [tuple(r) for r in toxicity.labelled(docs, labels).collect()]
    assert len(found) == 50 + 1 + 1 and ("text 1", 0) in found and ("text 1", 1) in found
    assert len({t for t, _ in toxicity.labelled(docs.filter("text <> 'text again'"), labels, 20).collect()}) == 20
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"), F.lit(1).alias("toxic"))
    assert toxicity.labelled(many, many, 3000).count() == 3000


# substrings


def deduplicated(rows, width):
    last = 1 << 62
    words = [(last if i is None else i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, ws in words:
        for k in range(len(ws) - width + 1):
            g = tuple(ws[k : k + width])
            first[g] = min(first.get(g, last), i)
    out = []
    for (i, _), (n, ws) in zip(rows, words, strict=True):
        gone = {j for k in range(len(ws) - width + 1) if first[tuple(ws[k : k + width])] < n for j in range(k, k + width)}
        out.append((i, len(ws), len(gone), " ".join(w for j, w in enumerate(ws) if j not in gone)))
    return ordered(out)


@pytest.mark.parametrize(("unit", "bucket"), [(1 << 21, 1 << 22), (30_000, 20_000)])
def test_substrings(docs, unit, bucket):
    rows = docs.select("doc_id", "text").filter("doc_id < 120")
    found = substring.dedup_substrings(clashing(rows), 13, unit, bucket).select("doc_id", "n_words", "n_removed", "text").collect()
    assert ordered(found) == deduplicated(pairs(rows), 13)


@pytest.mark.parametrize("width", [2, 3, 4, 13])
def test_substrings_of_odd_texts(spark, odd, width):
    draw = random.Random(width)
    made = [(draw.randrange(40), " ".join(draw.choice("abc") for _ in range(draw.randrange(12)))) for _ in range(60)]
    rows = odd.filter("doc_id is null or doc_id not in (7, 9)").unionByName(spark.createDataFrame(made, DDL))
    found = substring.dedup_substrings(rows, width, 200, 100).select("doc_id", "n_words", "n_removed", "text").collect()
    assert ordered(found) == deduplicated(pairs(rows), width)
    assert substring.dedup_substrings(rows.limit(0), width).count() == 0


def test_units_dont_depend_on_the_order_of_rows():
    draw = random.Random(2)
    rows = [(draw.choice([None, 1, 2, 3]), " ".join(draw.choice("abc") for _ in range(draw.randrange(30))).encode()) for _ in range(60)] + [(4, None)]
    seen = []
    for _ in range(3):
        draw.shuffle(rows)
        unit = substring._Unit(substring.pa.table({"doc_id": substring.pa.array([i for i, _ in rows], "int64"), "text": substring.pa.array([t for _, t in rows], "binary")}))
        at = unit.all_windows(4)
        keys, low, several, place = unit.distinct(at, 4, True)
        seen.append([x.tolist() for x in (at, *keys, low, several, place, unit.owner)])
    assert seen[0] == seen[1] == seen[2]


def test_messages_are_read_back():
    draw = np.random.default_rng(6)
    for buckets, count in ((1, 5), (7, 1000), (4000, 300)):
        keys = np.unique(np.concatenate([draw.integers(0, 1 << 47, count, dtype=np.uint64), [0, 1, (1 << 47) - 1]])).astype(np.uint64)
        several = draw.random(len(keys)) < 0.3
        sent = substring._sent(3, (keys,), np.zeros(len(keys), np.int64), several, buckets)
        back, answers = [], []
        for row in range(len(sent)):
            one = sent.slice(row, 1)
            value, n = substring._from_gaps(*substring.flat(one.column("hashes")), 2 * substring._floor(one.column("bucket")[0].as_py(), 47, buckets))
            assert n.tolist() == [len(value)]
            back += value.tolist()
            answers.append(substring._matched(one, buckets))
        assert back == (keys * np.uint64(2) + several).tolist()
        found, _ = substring._answered(keys, 47, buckets, substring.pa.concat_tables(answers))
        assert (found == several).all()


def test_levels_double_and_messages_keep_their_size():
    assert substring.levels(13) == [4, 7, 13] and substring.levels(2) == [1, 2] and substring.levels(50) == [4, 7, 13, 25, 50]
    for window in range(2, 200):
        x = substring.levels(window)
        assert x[-1] == window and x[0] <= 4 and all(a < b <= 2 * a for a, b in zip(x, x[1:], strict=False))
    for total in (10**6, 5 * 10**8, 3 * 10**10, 10**12, 10**13):
        units, buckets = substring.sizes(total)
        assert total / 6 / units / buckets >= 32 and total / units <= 64 << 20  # hashes in a message, bytes of a unit
    units, buckets = substring.sizes(10**14)
    assert total / 6 / units / buckets < 32 and 10**14 / units <= 64 << 20


def test_repeated_rows_are_dealt_over_units(spark):
    rows = spark.range(4000, numPartitions=8).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c d e f g h i j k l m n").alias("text"))
    found = substring.dedup_substrings(rows.unionByName(rows.limit(3).withColumn("doc_id", F.lit(9))), 13, 2000, 2000)
    units = [r["count"] for r in substring.in_units(rows, 100).groupBy("unit").count().collect()]
    assert sum(units) == 4000 and max(units) <= 1500 and len(units) >= 5
    removed = Counter((r["doc_id"], r["n_removed"]) for r in found.collect())
    assert removed == {(None, 14): 4000, (9, 0): 3}


# near copies


def print_of(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(text)
    if not words:
        return 0
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def grouped(rows):
    prints = [print_of(t) for _, t in rows]
    a, group = np.array(prints, np.uint64), list(range(len(rows)))
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a) <= 3):
            x, y = group[i], group[j]
            if x != y:
                group = [x if g == y else g for g in group]
    least = {}
    for g, (i, _) in zip(group, rows, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return ordered((i, f"{p:016x}", least.get(g)) for g, p, (i, _) in zip(group, prints, rows, strict=True))


def test_near_copies(docs, odd):
    for rows in (docs, odd):
        assert ordered(simhash.simhash_report(rows).collect()) == grouped(pairs(rows))
    assert simhash.simhash_report(odd.limit(0)).count() == 0


def similar(rows, least):
    """All pairs of rows whose sets of five-word runs have a Jaccard similarity of at least ``least``, by shared runs."""
    sets, having = [], defaultdict(list)
    for k, (_, t) in enumerate(rows):
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({" ".join(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {" ".join(words)})
        for g in sets[-1]:
            having[g].append(k)
    found = []
    for k, own in enumerate(sets):
        shared = Counter(j for g in own for j in having[g] if j < k)
        found += [(j, k, n / (len(own) + len(sets[j]) - n)) for j, n in shared.items() if n >= least * (len(own) + len(sets[j]) - n)]
    return found


def check_near_copies(rows, kept):
    """``kept`` are the places of the rows that stay."""
    pairs_ = similar(rows, 0.6)
    loose = simhash._roots(len(rows), *(np.array([p[i] for p in pairs_], np.int64) for i in range(2)))
    strict = simhash._roots(len(rows), *(np.array([p[i] for p in pairs_ if p[2] >= 0.9], np.int64) for i in range(2)))
    groups = defaultdict(set)
    for k in range(len(rows)):
        groups[int(loose[k])].add(k)
    # each loose group keeps at least one, and close copies don't stay beside each other
    assert all(g & kept for g in groups.values())
    assert len({int(strict[k]) for k in kept}) >= 0.998 * len(kept)
    # what goes has a neighbour that is nearly as close as asked for
    near = Counter()
    for a, b, s in pairs_:
        near[a], near[b] = max(near[a], s), max(near[b], s)
    gone = [near[k] for k in range(len(rows)) if k not in kept]
    assert all(s >= 0.65 for s in gone) and np.mean([s >= 0.8 for s in gone]) > 0.9


def test_near_copies_are_dropped(spark, sf):
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet").select("doc_id", "text")
    rows = sorted(pairs(docs))
    kept = {i for i, _ in pairs(simhash.drop_near_copies(docs))}
    check_near_copies(rows, {k for k, (i, _) in enumerate(rows) if i in kept})


def test_edits_up_to_the_similarity_are_caught(spark):
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randrange(2, 8)))
    made, caught = [], Counter()
    for k in range(200):
        words = [word() for _ in range(400)]
        edits = (0, 1, 3, 5)[k % 4]  # similarities of 1, 0.975, 0.93 and 0.88
        other = list(words)
        for j in range(edits):
            other[37 + 75 * j] = word()
        made += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other).upper() if k % 3 == 0 else " ".join(other))]
    kept = {i for i, _ in pairs(simhash.drop_near_copies(spark.createDataFrame(made, DDL)))}
    for k in range(200):
        assert 2 * k in kept
        caught[k % 4] += 2 * k + 1 not in kept
    assert [caught[k] for k in range(3)] == [50, 50, 50] and caught[3] >= 42  # 94 in 100 are expected


def test_rows_are_judged_by_their_own_text(spark):
    draw = random.Random(5)
    text = lambda n: " ".join("".join(draw.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    a, unlike, third, fourth = text(300), text(300), text(300), text(300)
    close = a.rsplit(" ", 1)[0] + " changed"
    made = [(1, a, "x"), (5, close, "x"), (5, unlike, "x"), (1, third, "y"), (None, fourth, "n"), (None, fourth + " more", "n"), (7, "", "e"), (8, None, "e"), (9, "   ", "e"), (3, "One two", "s"), (4, "one TWO", "s"), (6, "one two three", "s")]
    rows = spark.createDataFrame(made, DDL + ", other string")
    twice = rows.unionByName(rows).withColumns({"raw": F.lit(b"\x00\xff"), "nan": F.lit(float("nan")), "__h0": F.lit(1), "s0": F.lit(2), "node": F.lit(3), "big": F.lit("0.10").cast("decimal(20,8)")})
    for df in (rows, twice):
        got = simhash.drop_near_copies(df)
        assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in df.schema]
        found = {(r["doc_id"], r["text"]) for r in got.collect()}
        assert found - {(None, fourth), (None, fourth + " more")} == {(1, a), (5, unlike), (1, third), (7, ""), (3, "One two"), (6, "one two three")}
        assert len(found) == got.count() == 7
    row = simhash.drop_near_copies(twice).first()
    assert bytes(row["raw"]) == b"\x00\xff" and np.isnan(row["nan"]) and str(row["big"]) == "0.10000000"
    assert simhash.drop_near_copies(rows.limit(0)).count() == 0
    assert len(simhash.drop_near_copies(clashing(spark.createDataFrame(ODD, DDL))).collect()) > 3


def test_signatures_by_hand():
    sketch = simhash.Sketch(shingle=2, longs=2)
    texts = ["a b c d a b", "A b", "x", "", "a b c d a b"]
    raw = "".join(texts).encode()
    offsets = np.cumsum([0, *map(len, texts)])
    got = simhash.signatures(np.frombuffer(raw, np.uint8), offsets, sketch)
    words = simhash.Words(np.frombuffer(b"a b c d a b", np.uint8), np.array([0, 11])).hashes()
    runs = set(simhash.windows(words, 2, 7).tolist())
    assert len(runs) == 4
    for k in range(2):
        mixed = simhash.mix(np.array(list(runs), np.uint64), 20 + k)
        assert int(got[0, k]) == sum(1 << j for j in range(64) if 2 * int((mixed >> np.uint64(j) & np.uint64(1)).sum()) > 4)
    assert (got[0] == got[4]).all() and not got[3].any() and got[1].any() and got[2].any()


def test_balls_find_all_close_prints(spark):
    draw = np.random.default_rng(3)
    values = set()
    for centre in draw.integers(0, 2**63, 40, dtype=np.uint64) * np.uint64(2):
        for _ in range(12):
            flips = draw.choice(64, draw.integers(0, 6), replace=False)
            values.add(int(centre) ^ sum(1 << int(j) for j in flips))
    v = np.array(sorted(values), np.uint64)
    found = simhash.near_pairs(spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp long")).collect()
    at = {int(x): i for i, x in enumerate(v.view(np.int64))}
    got = simhash._roots(len(v), np.array([at[r["src"]] for r in found]), np.array([at[r["dst"]] for r in found]))
    assert (got == simhash._roots(len(v), *np.nonzero(np.bitwise_count(v[:, None] ^ v[None, :]) <= 3))).all()


# the pipeline


def test_pipeline(spark, docs, sf):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_copies", "secrets", "mixture", "packed"]
    step = docs
    outs = {}
    for name, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, sf)
        if name != "packed":
            assert step.columns == docs.columns
            step = step.cache()
        outs[name] = step
    known = pairs(outs["language"])
    assert len(known) >= 0.98 * docs.count()
    kept = {i for i, _ in pairs(outs["near_copies"])}
    check_near_copies(known, {k for k, (i, _) in enumerate(known) if i in kept})
    for i, t in pairs(outs["secrets"]):
        assert base_spans(t) == "" and i in kept
    check_packed(pairs(outs["mixture"]), outs["packed"].collect())
    # where documents are cut depends on the partitions, the ids don't
    total = lambda df: df.agg(F.sum("length"), F.countDistinct("doc_id")).first()
    assert total(corpus_pipeline.run(spark, sf)) == total(outs["packed"])
