import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
import xxhash
import public_tokenizers
from pyspark.sql import functions as F

from recordloom.llm import bpe, decontaminate, language, lines, near, pages, pii, ppm, quality, simhash, topk
from recordloom.llm.queries import op10_decontaminate, op3_lines, op6_topk

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, items string, scan string, pii_spans string"
ODD = [
    (1, None, "en", "x", "y", "z"),
    (2, "", "en", "x", "y", "z"),
    (None, "one two three four five six seven eight nine ten", None, None, None, None),
    (3, "same line with more than eight words in it today", "en", None, None, None),
    (3, "same line with more than eight words in it today", "en", None, None, None),
    (4, "Same  line with more than eight words in it today\nown", "fr", None, None, None),
    (5, "été " * 40_000, "fr", None, None, None),
    (6, "...!!! 123", None, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def test_ppm_matches_a_walk_over_contexts(spark):
    random.seed(3)
    rows = [(i, "".join(random.choice("ab c") for _ in range(random.randint(0, 40)))) for i in range(60)]
    rows.append((61, "zzé"))
    train = [t.encode() for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    top = ppm.ORDER
    counts = [collections.defaultdict(collections.Counter) for _ in range(top + 1)]
    for t in train:
        s = b"\xff" * top + t + b"\xff"
        for i in range(top, len(s)):
            counts[top][s[i - top : i]][s[i]] += 1
    for o in range(top - 1, -1, -1):
        for context, symbols in counts[o + 1].items():
            for symbol in symbols:
                counts[o][context[1:]][symbol] += 1

    def cost(t):
        s, total = b"\xff" * top + t + b"\xff", 0.0
        for i in range(top, len(s)):
            out = set()
            for o in range(top, -1, -1):
                left = {k: v for k, v in counts[o].get(s[i - o : i], {}).items() if k not in out}
                if not left:
                    continue
                n = sum(left.values())
                if s[i] in left:
                    total += math.log10((left[s[i]] - 0.5) / n)
                    break
                total += math.log10(len(left) / 2 / n)
                out |= set(left)
            else:
                total -= math.log10(256 - len(out))
        return total

    words = collections.Counter(w for t in train for w in [*t.split(), b"end"])
    n, v = sum(words.values()), len(words)
    found = ppm.ppm_scores(spark.createDataFrame(rows, "doc_id long, text string"), part_bytes=300).collect()
    assert len(found) == len(rows)
    texts = dict(rows)
    for r in found:
        own = [*texts[r.doc_id].encode().split(), b"end"]
        assert r.score == pytest.approx(cost(texts[r.doc_id].encode()), abs=1e-8)
        assert r.base_score == pytest.approx(sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(words[w] > 0 for w in own), n)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)


def test_ppm_makes_the_texts_and_words_of_one_slice_at_a_time(monkeypatch):
    """A part of 20,000 texts of which every word is new: arrays stay, the words and texts of a slice go."""
    texts = [" ".join(f"w{i}x{j}" for j in range(20)) for i in range(20_000)]
    table = pa.table({"part": [0] * len(texts), "held_out": [i % 10 == 0 for i in range(len(texts))], "text": pa.chunked_array([texts])})
    most, made = 0, ppm.text_bytes

    def counted(column):
        nonlocal most
        most = max(most, len(column))
        return made(column)

    monkeypatch.setattr(ppm, "text_bytes", counted)
    found = ppm._gather(table).to_pandas()
    assert most < len(texts) / 2
    words = found[found.kind == 1].set_index("key").c
    assert len(words) == 400_001 and words[ppm.word_key(ppm.END_WORD)] == 18_000
    assert words[ppm.word_key(b"w1x1")] == 1 and words[ppm.word_key(b"w10x1")] == 0
    assert found[found.kind == 0].c.sum() == sum(len(t) + 1 for i, t in enumerate(texts) if i % 10)


def test_bpe_matches_the_library(spark):
    ranks = bpe.Codec(bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY)), public_tokenizers.PATTERN).ranks
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    cases = ["", None, "a" * 700 + "bcd" * 90, " \n\n x  ", "日本語" * 30, "\x00!?!?" * 60, "<|endoftext|>", "it's 12345"]
    found = bpe.encode_decode(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()
    assert len(found) == len(cases)
    for r in found:
        text = cases[r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == plain.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode()


def test_bpe_contraction_has_one_row_for_each_word():
    """A step of the recursion holds words with their tokens, not one row for every token of every step."""
    codec = bpe.Codec(bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY)), public_tokenizers.PATTERN)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    words = ["x", "qzqzqzqz", "abcdefgh" * 12, "日本語" * 9, "!?" * 40, *("zq" * n for n in range(1, 40))]
    state = pa.table({"word": range(len(words)), "tokens": [codec.single[list(word.encode())].tolist() for word in words]})
    codec.db.register("state", state)
    found = codec.db.sql(bpe.ENCODE).fetchall()
    assert sorted(word for word, _, _ in found) == list(range(len(words)))
    assert all(tokens == plain._encode_single_piece(words[word]) for word, tokens, done in found if done)
    assert any(done for _, _, done in found) and not all(done for _, _, done in found)
    codec.learn(words)
    assert [np.frombuffer(codec.words[w], "<u4").tolist() for w in words] == [plain._encode_single_piece(w) for w in words]


def test_lines_keep_the_earliest(spark, odd, none):
    found = lines.without_repeats(odd).collect()
    assert len(found) == len(ODD)
    by = collections.defaultdict(list)
    for r in found:
        by[r.doc_id].append(r)
    assert [r.text for r in by[3]] == [ODD[3][1]] * 2
    assert by[4][0].text == "own" and by[4][0].removed[0].first_doc == 3
    assert by[1][0].text is None and by[2][0].text == ""
    assert lines.without_repeats(none).count() == 0


def test_lines_match_brute_force(spark, texts):
    seen, expected = {}, {}
    for doc_id in sorted(texts):
        text, kept, done = texts[doc_id], [], 0
        for start, end, _, digest in lines.units(text, "line", 3):
            if digest in seen:
                kept.append(text[done:start])
                done = end + (text[end : end + 1] == "\n")
            seen.setdefault(digest, doc_id)
        expected[doc_id] = "".join([*kept, text[done:]])
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert {r.doc_id: r.text or "" for r in lines.without_repeats(docs, min_words=3).collect()} == expected


def test_lines_of_any_length_leave_none_twice(spark, texts):
    seen, expected = set(), {}
    for doc_id in sorted(texts):
        kept = []
        for line in re.split(r"(?<=\n)", texts[doc_id]):
            words = tuple(line.lower().split())
            if not words or words not in seen:
                kept.append(line)
            seen.add(words)
        expected[doc_id] = "".join(kept)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = {r.doc_id: r.text or "" for r in lines.without_repeats(docs).collect()}
    assert found == expected
    repeated = "Released under the MIT license.\nown %d"
    docs = spark.createDataFrame([(i, repeated % i) for i in range(3)], "doc_id long, text string")
    assert [r.text for r in lines.without_repeats(docs).orderBy("doc_id").collect()] == [repeated % 0, "own 1", "own 2"]


def test_op3_matches_brute_force(spark, texts):
    """Sentences one after another in the order of ids, without digests: later ones go in runs of 40 words or more."""
    seen, expected = set(), {}
    for doc_id in sorted(texts):
        text, spans, run = texts[doc_id], [], []
        own = set()
        for start, end, n, _ in [*lines.units(text, "sentence", 1), (0, 0, 0, b"")]:
            words = tuple(text[start:end].lower().split())
            if words and words in seen | own:
                run.append((start, end, n))
            else:
                spans += [(s, e) for s, e, _ in run] if sum(n for _, _, n in run) >= 40 else []
                run = []
            own.add(words)
        seen |= own
        expected[doc_id] = spans
    rows = op3_lines(spark, SMALL).collect()
    assert {r.doc_id: [(s.start, s.end) for s in r.removed] for r in rows} == expected
    assert any(expected.values())
    left = {r.doc_id: "".join((r.text or "").split()) for r in rows}
    for doc_id, spans in expected.items():
        text = texts[doc_id]
        outside = "".join(text[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(text)], strict=True))
        assert left[doc_id] == "".join(outside.split())


def test_op3_finds_planted_passages_and_leaves_clean_documents_alone(spark):
    random.seed(8)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(5))
    sentence = lambda: " ".join(word() for _ in range(random.randint(4, 12))).capitalize() + "."
    passages = [" ".join(sentence() for _ in range(8)) for _ in range(10)]
    common = ["All rights reserved.", "Of.", "Released under the terms of the license."]
    rows, planted = [], set()
    for i in range(200):
        body = [sentence() for _ in range(20)]
        body.insert(5, random.choice(common))
        if i % 2:
            passage = passages[i % 20 // 2]
            # a line of its own, inside a line, and broken over lines elsewhere
            body.insert(10, [f"\n{passage}\n", passage, passage.replace(". ", ".\n")][i % 3])
            if i >= 20:
                planted.add(i)
        rows.append((i, " ".join(body)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id for r in lines.without_repeats(docs, unit="sentence", min_run=40).collect() if r.removed}
    assert found == planted


def test_lines_odd_tables(spark, none):
    long = " ".join(f"w{i}" for i in range(60)) + "."
    rows = [(1, long, 7, 7), (None, long, 7, 7), (2, f"A b. {long} C d.\n{long}\nE", 7, 7), (2, f"A b. {long} C d.\n{long}\nE", 7, 7), (2, long, 7, 7)]
    docs = spark.createDataFrame(rows + [(3, "." * 300_000 + "x" * 300_000, 1, 1)], "doc_id long, text string, digest int, removed int")
    found = lines.without_repeats(docs, unit="sentence", min_run=40).collect()
    assert sorted((r.doc_id or 0, r.text[:20]) for r in found) == [(0, ""), (1, long[:20]), (2, ""), (2, "A b. C d.\nE"), (2, "A b. C d.\nE"), (3, "." * 20)]
    assert {s.first_doc for r in found for s in r.removed} == {1}
    alone = spark.createDataFrame([(None, f"{long}\n{long}")], "doc_id long, text string")
    assert [(s.start, s.first_doc, s.first_start) for s in lines.without_repeats(alone).first().removed] == [(len(long) + 1, None, 0)]
    for unit in lines.UNITS:
        assert lines.without_repeats(none, unit=unit).count() == 0


def test_languages(spark, odd, none):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = language.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang_pred <> 'und'")
    right, n = found.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 20 and right / n > 0.9
    rows = {r.doc_id: r for r in language.languages(odd).collect()}
    assert {rows[i].lang_pred for i in (1, 2, 6)} == {"und"} and rows[5].lang_pred in ("en", "fr")
    assert language.languages(none).count() == 0


def test_quality(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    found = quality.quality(docs, labels).join(labels, "doc_id").where("held_out")
    right, n = found.agg(F.count_if(F.col("predicted") == F.col("quality")), F.count("*")).first()
    assert n > 30 and right / n > 0.9
    rows = quality.quality(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert quality.accepted(odd, labels).columns == odd.columns
    assert quality.quality(none, labels).count() == 0


def test_top_k_matches_all_products(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    table = np.floor(256 * np.array([r.embedding for r in rows], np.float32).astype(float)).astype(int)
    ids = np.array([r.vec_id for r in rows])
    found = collections.defaultdict(list)
    for r in op6_topk(spark, SMALL).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    assert set(found) == {i for i in ids if i % 50 == 0}
    for query, best in found.items():
        score = table @ table[ids == query][0]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != query][:5]
        assert best == [(ids[i], score[i]) for i in order]


def test_top_k_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [1.0, 2.0]), (5, [1.0, 2.0]), (5, [1.0, 2.0]), (6, [1.0]), (None, [1.0, 1.0])]
    vectors = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    found = topk.top_k(vectors, vectors.where("vec_id = 0"), 2).orderBy("rank").collect()
    assert [(r.rank, r.vec_id) for r in found] == [(1, 4), (2, 5)]
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_pseudonyms():
    cases = {
        "card": "4111 1111 1111 1111", "date": "1987-02-28", "ip": "10.0.255.7", "phone": "+1 (017) 555-7713",
        "ssn": "123-45-6789", "email": "ann.lee@mail.example.com", "secret": "9233a8ecf7c5b09fe5949719b6b82bc439e9329b",
    }
    for kind, value in cases.items():
        text, spans = pii.replace(f"x {value}, y {value}.", b"k")
        assert [s[2] for s in spans] == [kind] * 2, kind
        first, second = text[2:].removesuffix(".").split(", y ")
        assert first == second != value
        assert kind == "ip" or len(first) == len(value)
    digits = pii.replace(cases["card"], b"k")[0].replace(" ", "")
    assert pii.check_digit(digits[:-1]) == digits[-1]
    for invalid in ("4111 1111 1111 1112", "1987-02-30", "300.1.1.1", "version 3.1"):
        assert pii.replace(invalid, b"k") == (invalid, [])
    for radix, n in ((10, 3), (36, 2), (10, 1)):
        values = {tuple(pii.permute([v // radix**i % radix for i in range(n)], radix, b"k", b"t")) for v in range(radix**n)}
        assert len(values) == radix**n
    same = [pii.pseudonym("date", d, b"k") for d in ("2001-03-04", "04/03/2001", "04.03.2001")]
    year, month, day = same[0].split("-")
    assert same[1] == f"{day}/{month}/{year}" and same[2] == f"{day}.{month}.{year}"


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("4111 1111 1111 1111 123", {"card": "4111 1111 1111 1111"}),
        ("4111111111111111 12/27", {"card": "4111111111111111"}),
        ("4111-1111-1111-1111-123", {"card": "4111-1111-1111-1111"}),
        ("0000-4111-1111-1111-1111", {"card": "4111-1111-1111-1111"}),
        ("no 12 4111 1111 1111 1111 12/2027", {"card": "4111 1111 1111 1111"}),
        ("1234 4111 1111 1111 1111", {"card": "4111 1111 1111 1111"}),
        ("4111 1111 1111 1111 2001-03-04", {"card": "4111 1111 1111 1111", "date": "2001-03-04"}),
        ("7 2001-03-04 4111 1111 1111 1111", {"date": "2001-03-04", "card": "4111 1111 1111 1111"}),
        ("1234567890123457 017-555-7713", {"phone": "017-555-7713"}),
        ("born 12/31/1987.", {"date": "12/31/1987"}),
        ("at 1987-02-28T10:00:00Z", {"date": "1987-02-28"}),
        ("at 1987-02-28T10:00:00+01:00", {"date": "1987-02-28"}),
    ],
)
def test_pseudonyms_beside_other_digits(text, kinds):
    new, spans = pii.replace(text, b"k")
    assert [(kind, text[start:end]) for start, end, kind in spans] == list(kinds.items())
    assert len(new) == len(text) and not any(value in new for value in kinds.values())


def test_pseudonyms_of_dates_with_the_month_first():
    days = [f"{m:02d}/{d:02d}/{y}" for y in (1950, 1987) for m in range(1, 13) for d in range(1, 29)]
    made = [pii.pseudonym("date", day, b"k") for day in days]
    assert len(set(made)) == len(days)
    assert all((int(a[3:5]) > 12) == (int(b[3:5]) > 12) for a, b in zip(days, made, strict=True))
    for invalid in ("13/13/1987", "1987-02-30T10:00:00Z", "1987-02-28Tuesday", "411111111111111112"):
        assert pii.replace(invalid, b"k") == (invalid, [])


def test_pseudonyms_on_odd_tables(odd, none):
    rows = pii.pseudonymised(odd).collect()
    assert len(rows) == len(ODD) and {r.doc_id: r.text for r in rows}[1] is None
    assert pii.pseudonymised(none).count() == 0


def plain_fingerprint(text):
    words = text.encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_matches_all_pairs(spark, texts):
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    root = {i: i for i in prints}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                low, high = sorted((top(a), top(b)))
                root[high] = low
    found = simhash.near_groups(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()
    assert {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in found} == {i: (prints[i], top(i)) for i in prints}


def test_simhash_splits_crowds(spark):
    random.seed(5)
    base = random.getrandbits(64)
    values = {base ^ (1 << a) ^ (1 << b) for a in range(24) for b in range(24)} | {random.getrandbits(64) for _ in range(200)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    table = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = {v: v for v in signed}
    from recordloom.llm.components import components

    found |= {r.u: r.v for r in components(simhash.links(table, 3, crowd=50)).collect()}
    root = {v: v for v in signed}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) % (1 << 64)).bit_count() <= 3:
                low, high = sorted((top(a), top(b)))
                root[high] = low
    assert found == {v: top(v) for v in signed}


def test_simhash_odd(odd, none):
    rows = simhash.near_groups(odd).collect()
    assert len(rows) == len(ODD) and {r.component_id for r in rows if r.doc_id in (1, 2)} == {1}
    assert simhash.near_groups(none).count() == 0


def five_words(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def first_of_copies(rows):
    """Rows (id, text) that stay, by comparing all pairs."""
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    sets, root = [five_words(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or (a and b and len(a & b) * 5 >= len(a | b) * 4):
                low, high = sorted((top(i), top(j)))
                root[high] = low
    groups = collections.defaultdict(list)
    for i, row in enumerate(rows):
        groups[top(i)].append(row)
    return [{row for row in group if row[0] == group[0][0]} for group in groups.values()]


def edited_copies():
    random.seed(8)
    word = lambda: "w%d" % random.randrange(3000)
    rows, common = [], [word() for _ in range(30)]
    for _ in range(60):
        base = [word() for _ in range(random.choice((3, 6, 20, 60, 200)))] + common * random.randrange(2)
        for _ in range(random.randrange(1, 6)):
            own = list(base)
            for _ in range(random.randrange(0, max(1, len(own) // 25) + 1)):
                own[random.randrange(len(own))] = word()
            rows.append((len(rows), random.choice((" ", "  ", "\n")).join(own).upper() if random.random() < 0.3 else " ".join(own)))
    base = [word() for _ in range(80)]
    for _ in range(40):  # a large group whose members differ from each other
        base = list(base)
        base[random.randrange(80)] = word()
        rows.append((len(rows), " ".join(base)))
    return rows


def check_first_rows(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    import corpus_pipeline

    found = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, SMALL).collect()]
    groups = first_of_copies(rows)
    assert len(found) == len(groups)
    assert all(len(group & set(found)) == 1 for group in groups)


def test_pipeline_near_copies_match_all_pairs(spark, texts):
    rows = edited_copies()
    assert len(first_of_copies(rows)) < len({t.lower() for _, t in rows}) - 20
    check_first_rows(spark, rows + [(1000 + i, t) for i, t in texts.items()])


def test_pipeline_near_copies_of_one_text_are_not_all_candidates(spark, monkeypatch):
    random.seed(5)
    base, rows = [f"w{i}" for i in range(150)], []
    for i in range(150):  # three far edits each: about 0.66 alike, fewer in common with the base than linked texts have
        own = list(base)
        for place in random.sample(range(5, 145), 3):
            own[place] = f"x{i}_{place}"
        rows.append((i, " ".join(own)))
    rows += [(200 + i, f"y{i} " + rows[i][1]) for i in range(0, 150, 10)]
    asked, confirmed = [], near._confirmed
    monkeypatch.setattr(near, "_confirmed", lambda pairs, *more: asked.append(pairs.count()) or confirmed(pairs, *more))
    for most in (near.GROUP_ROWS, 40) if hasattr(near, "GROUP_ROWS") else (None,):
        monkeypatch.setattr(near, "GROUP_ROWS", most, raising=False)
        check_first_rows(spark, rows)
    assert sum(asked) < 2 * len(asked) * len(rows)


def test_pipeline_near_copies_come_from_the_simhash_index(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(400)) for x in "ab")
    rows = [(2, a), (1, a + " end"), (3, b), (4, None), (5, "one"), (6, "two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__row", F.col("doc_id").cast("string").cast("binary"))
    nodes = near._nodes(docs)
    ids = {r.id: r.first.doc_id for r in nodes.collect()}
    reached = [{ids[r.u], ids[r.v]} for r in near._fingerprint_links(nodes).collect()]
    assert {1, 2} in reached and not any(3 in pair for pair in reached)
    check_first_rows(spark, rows)


def test_pipeline_keeps_different_texts_of_null_and_repeated_ids(spark, none):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (3, d + " end"), (None, c), (None, None), (None, " "), (8, "short text"), (9, "short text too")]
    check_first_rows(spark, rows)
    assert near.first_rows(none).count() == 0 and near.first_rows(none).columns == none.columns


PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href="/">Home</a></ul></nav>
<div class="cookie-notice">We use cookies.</div><article><h1>Head &amp; line</h1><p>First <b>bold</b> text, long enough
to count.<p>Second&nbsp;one.<ul><li>item<li>more</ul><form>Name <input></form></article>
<section class="comments"><p>A reader said a lot, and more, and more.</p></section><footer>&copy; us</footer></body></html>"""


def test_pages(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "", ""), (4, "u", "<p>cut off here, really.</p><p"), (5, "u", "just text.")]
    found = {r.page_id: r for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[1].text == "Head & line\n\nFirst bold text, long enough to count.\n\nSecond one.\n\nitem\n\nmore"
    assert [found[i].text for i in (2, 3, 4, 5)] == ["", "", "cut off here, really.", "just text."]
    assert all(r.n_chars == len(r.text) for r in found.values())


@pytest.mark.parametrize("wrapper", ["article", "div"])
def test_pages_keep_paragraphs_beside_a_long_quote(wrapper):
    parts = [f"<h2>Head {i}</h2>" + "".join(f"<p>{f'{i} {j}'.ljust(249, 'x')}.</p>" for j in range(6)) for i in range(5)]
    page = f"<body><{wrapper}>{''.join(parts)}<blockquote><p>{'quote ' * 1000}.</p></blockquote></{wrapper}></body>"
    assert len(pages.main_blocks(page)) == 36


@pytest.mark.parametrize("name", ["layout has-sidebar", "post has-comments", "search", "tags meta share"])
def test_pages_keep_text_in_named_wrappers(name):
    own = "<h1>Head</h1><p>The text, which is long enough.</p><p>And more of it, too.</p>"
    beside = "<div class='sidebar'><p>Beside it.</p></div><div class='comments'><p>A reader.</p></div>"
    kept = ["Head", "The text, which is long enough.", "And more of it, too."]
    for page in (
        f"<body><div class='{name}'><article>{own}</article>{beside}</div></body>",
        f"<body><article class='{name}'>{own}{beside}</article></body>",
        f"<body><div class='{name}'>{own}</div>{beside}</body>",
        f"<body><div class='{name}'><article>{own}</article><div id='comments'><article><p>{'A reader. ' * 99}</p></article></div></div></body>",
        f"<html><head><title>T</title><meta charset=utf-8><body><div>{own}</div>{beside}</body>",
    ):
        assert pages.main_blocks(page) == kept, page


def plain_scan(text, items, size=10):
    words, hit, names = decontaminate.normal_words(text.encode()), set(), set()
    for item, benchmark in items:
        for window in decontaminate.windows(benchmark.encode(), size):
            parts = window.split(b" ")
            for i in range(len(words) - len(parts) + 1):
                if words[i : i + len(parts)] == parts:
                    hit.update(range(i, i + len(parts)))
                    names.add(str(item))
    return len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def test_decontamination_matches_brute_force(spark, texts):
    items = [(r.item_id, r.text or "") for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    some = sorted(texts)[::4]
    found = {r.doc_id: tuple(r)[1:] for r in op10_decontaminate(spark, SMALL).collect()}
    assert set(found) == set(texts) and any(r[-1] for r in found.values())
    for i in some:
        assert found[i] == plain_scan(texts[i], items)


def test_decontamination_odd(spark, odd, none):
    schema = "item_id long, text string"
    bench = spark.createDataFrame([(1, "Seven, eight!"), (1, None), (None, "one"), (2, ""), (3, "ÉTÉ")], schema)
    whole, split = (decontaminate.scan(odd, bench, limit=limit).collect() for limit in (1 << 20, 8))
    assert sorted(map(str, whole)) == sorted(map(str, split)) and len(whole) == len(ODD)
    hit = {r.doc_id: r.scan for r in whole}[None]
    assert hit["items"] == [1] and ODD[2][1][hit["char_starts"][0] : hit["char_ends"][0]] == "seven eight"
    cleaned = {r.doc_id: r.text for r in decontaminate.without_passages(odd, bench).collect()}
    assert cleaned[None] == "one two three four five six  nine ten" and cleaned[1] is None
    parts = decontaminate.without_passages(odd, bench, limit=8)
    assert {r.doc_id: r.text for r in parts.collect()} == cleaned and parts.columns == odd.columns
    assert decontaminate.scan(none, bench).count() == 0 == decontaminate.scan(none, bench.limit(0)).count()


def test_pipeline_stages_do_their_work(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
    rows = docs.collect()
    items = [(r.item_id, r.text or "") for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    prints = [plain_fingerprint(r.text or "") for r in corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{SMALL}/documents.parquet"), SMALL).collect()]
    assert 0 < len(rows) <= len(set(prints))
    assert all(r.n_chars == len(r.text) for r in rows if r.text)
    assert not any(plain_scan(r.text or "", items)[-1] for r in rows[:25])
    final = {r.doc_id: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert {r.doc_id for r in rows} == set(final)
    for r in rows:
        assert final[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
