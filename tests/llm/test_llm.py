import base64
import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from glossmill.llm import queries as Q
from . import brute

LONG = " ".join(f"w{i}" for i in range(60))
OTHER = " ".join(f"v{i % 37}" for i in range(80))
#: doc_id, text: nulls, empty and very long texts, ties, repeated rows.
EDGE = [
    (1, LONG), (2, LONG), (2, LONG), (3, LONG + " tail"), (4, None), (5, ""), (6, " \t\n"), (None, LONG), (7, "A b"), (8, "a B"),
    (9, OTHER), (10, OTHER.upper()), (11, "x " * 30_000), (12, "#*$ é ß \U0001f600 |\n|\n|"), (13, " ".join(OTHER.split()[:40]) + " " + LONG), (None, None),
    (14, "same words here " * 9), (9, "another text under a used id"), (15, "\x00 \x1f a\x7fb"),
]


def rows_of(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(d, t, 1.0, "x") for d, t in EDGE], "doc_id long, text string, score double, set_id string")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def empty(edge):
    return edge.where("false")


def test_chat(spark, sf):
    from glossmill.llm.chat import BEGIN, expand_turns, read_back

    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in Q.op1_chat(spark, sf).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    assert got == brute.chat([*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)])
    odd = [(1, 0, "user", None), (1, 0, "assistant", "[\\INST] [INST] <s> <<SYS>> </s>\n"), (1, None, None, ""), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (None, 1, "user", "x" * 50_000), (3, 1, "user", BEGIN)]
    frame = spark.createDataFrame([(*r, 0, "t") for r in odd], "conv_id long, turn long, role string, text string, n_turns int, prefix string")
    made = expand_turns(frame)
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in read_back(made).collect()} == brute.chat(odd)
    assert read_back(expand_turns(frame.where("false"))).count() == 0


def test_chat_examples_hold_their_context(spark):
    from glossmill.llm.chat import expand_turns

    frame = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "b")], "conv_id long, turn long, role string, text string")
    first, second = expand_turns(frame).orderBy("example_no").collect()
    assert second.text.startswith(first.text) and first.text[first.loss_start : first.loss_end] == "a" and second.text[second.loss_start : second.loss_end] == "b"


def test_chat_frames_are_bounded(spark):
    """20,000 conversations of one reply: no frame goes above the bound by more than its last example."""
    from glossmill.llm.chat import packed

    sizes = [sum(map(len, f["text"])) for f in packed((i, 0, 1, "x" * 4_000, 0, 4_000, True) for i in range(20_000))]
    assert sum(sizes) == 80_000_000 and max(sizes) <= 4_004_000


def test_jaccard(spark, sf, docs, edge, empty):
    from glossmill.llm.jaccard import similar_components

    assert rows_of(Q.op2_jaccard(spark, sf), "doc_id", "n_shingles", "component_id") == brute.jaccard(docs)
    assert rows_of(similar_components(edge), "doc_id", "n_shingles", "component_id") == brute.jaccard(EDGE)
    assert similar_components(empty).count() == 0


@pytest.mark.parametrize("left_at_once", [20_000, 2])
def test_jaccard_chains_and_borders(spark, left_at_once):
    from glossmill.llm.jaccard import similar_components

    rng, rows = random.Random(3), []
    for base in range(12):
        text = [f"b{base}x{i}" for i in range(rng.randint(20, 90))]
        for step in range(12):
            rows.append((len(rows) * 7 % 149, " ".join(text)))
            text[rng.randrange(len(text))] = f"n{len(rows)}"
            if rng.random() < 0.4:
                text.append(f"t{len(rows)}")
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(similar_components(frame, left_at_once=left_at_once), "doc_id", "n_shingles", "component_id") == brute.jaccard(rows)


def test_jaccard_skips_no_link_within_blocks(spark):
    """Sets of few sizes that share their rarest shingles at all places: pairs of a list against the plain bounds."""
    import numpy as np
    import pyarrow as pa

    from glossmill.llm.jaccard import _cross

    rng = np.random.default_rng(6)
    n = np.sort(rng.integers(20, 40, 300))
    pos = rng.integers(0, n // 5 + 1)
    order = np.lexsort((pos, n))
    n, pos, sid, comp = n[order], pos[order], rng.permutation(300), rng.integers(0, 40, 300)
    part = lambda p: pa.RecordBatch.from_pydict({"token": np.zeros(300, np.int64), "part": np.full(300, p, np.int32), "left": sid % 3 == p, "sid": sid, "n": n.astype(np.int32), "pos": pos.astype(np.int32), "comp": comp})
    got = [tuple(sorted(p)) for b in _cross(part(p) for p in range(3)) for p in zip(*(b.column(c).to_pylist() for c in "ab"))]
    can = lambda i, j: comp[i] != comp[j] and 5 * min(n[i], n[j]) >= 4 * max(n[i], n[j]) and 9 * min(n[i] - pos[i], n[j] - pos[j]) >= 4 * (n[i] + n[j])
    assert sorted(got) == sorted(tuple(sorted((int(sid[i]), int(sid[j])))) for i in range(300) for j in range(i) if can(i, j))


@pytest.mark.parametrize("largest", [6, 40, 400])
def test_jaccard_lists_hold_only_sets_that_can_be_linked(largest):
    """Rows of an index list stay if another one of it is near enough in size and place, wherever batches end; long lists stay as they are."""
    import numpy as np
    import pyarrow as pa

    from glossmill.llm.jaccard import _met

    rng = np.random.default_rng(largest)
    for _ in range(60):
        m = int(rng.integers(1, 80))
        token, n = np.sort(rng.integers(-5, 6, m)), rng.integers(1, largest, m)
        n = n[np.lexsort((n, token))]
        pos = rng.integers(0, n // 5 + 1)
        rows = pa.RecordBatch.from_pydict({"token": token, "sid": np.arange(m), "n": n.astype(np.int32), "pos": pos.astype(np.int32)})
        can = lambda i, j: 5 * min(n[i], n[j]) >= 4 * max(n[i], n[j]) and 9 * min(n[i] - pos[i], n[j] - pos[j]) >= 4 * (n[i] + n[j])
        want = [i for i in range(m) if any(token[i] == token[j] and i != j and can(i, j) for j in range(m))]
        cuts = sorted({0, m, *rng.integers(0, m + 1, 5).tolist()})
        ids = lambda *most: [i for b in _met((rows.slice(a, b - a) for a, b in zip(cuts, cuts[1:])), *most) for i in b.column("sid").to_pylist()]
        assert ids() == want
        assert (some := ids(5)) == sorted(set(some)) and set(want) <= set(some)


def test_jaccard_shuffles_only_texts_that_pairs_ask_for(spark):
    from glossmill.llm.jaccard import _let_through

    texts = spark.range(2000).selectExpr("id sid", "concat('text ', id) text")
    kept = _let_through(texts, F.xxhash64("sid"), spark.range(40, 50).toDF("sid"), F.xxhash64("sid")).collect()
    assert {(i, f"text {i}") for i in range(40, 50)} <= {tuple(r) for r in kept} and len(kept) < 20


def test_jaccard_of_a_hub(spark):
    """Thousands of near copies of one text: all are found, and no task of the join has most of the pairs."""
    from glossmill.llm.jaccard import similar_components
    from glossmill.llm.skew import heavy_keys, spread_join

    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[: i % 50 + 3], f"x{i}", *base[i % 50 + 3 :]])) for i in range(500)] + [(-1, " ".join(base))]
    found = similar_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.component_id for r in found.collect()} == {-1}
    pairs = spark.range(4000).selectExpr("if(id < 3900, 7, id) a", "id b")
    joined = spread_join(pairs, spark.range(4000).selectExpr("id a", "'t' text"), "a", heavy_keys(pairs, "a", 4000, 8))
    sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 4000 and {(r.a, r.b) for r in joined.collect()} == {(r.a, r.b) for r in pairs.collect()}


def test_rules(spark, sf, docs, edge, empty):
    from glossmill.llm.rules import quality_rules

    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert rows_of(Q.op3_rules(spark, sf), *names) == sorted(((d, *brute.rules(t)) for d, t in docs), key=str)
    assert rows_of(quality_rules(edge), *names) == sorted(((d, *brute.rules(t)) for d, t in EDGE), key=str)
    assert quality_rules(edge).where("kept and base_failed").count() == 0
    assert quality_rules(empty).count() == 0


def check_mix(rows, sizes):
    goals = brute.targets({s: sum(x for _, t, x in sizes if t == s) for s in {t for _, t, _ in sizes}})
    taken, most = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.target == pytest.approx(goals[r.source], abs=1e-6) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
    for s, goal in goals.items():
        assert abs(taken[s] - goal) <= max(most[s], 1)
    assert sorted((r.doc_id, r.source, r.size) for r in rows if r.doc_id is not None) == sorted(x for x in sizes if x[0] is not None)


def test_mix(spark, sf, empty):
    from glossmill.llm.mixing import mix

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check_mix(Q.op4_mix(spark, sf).collect(), [(r.doc_id, r.source, len(brute.words(r.text))) for r in docs.collect()])
    odd = [(i, None if i % 9 == 0 else "hot" if i % 3 else f"s{i % 5}", "w " * (i % 50) if i % 7 else None) for i in range(300)] + [(1, "alone", "a b")] * 2
    frame = spark.createDataFrame([(*r, 3, "t") for r in odd], "doc_id long, source string, text string, size int, target string")
    rows = mix(frame).collect()
    check_mix(rows, [(d, s, len(brute.words(t))) for d, s, t in odd])
    assert sorted(map(str, rows)) == sorted(map(str, mix(frame.repartition(3)).collect()))
    assert mix(empty.withColumn("source", F.lit("a"))).count() == 0


def test_tokens(spark, sf, docs, edge, empty):
    from tokenizers import Tokenizer

    from glossmill.llm.tokens import token_counts

    path = Q.tokenizer_path()
    own = Tokenizer.from_file(path)

    def plain(rows):
        return sorted(((d, len((t or "").encode()), n := len(own.encode(t or "", add_special_tokens=False).ids), n > 2048) for d, t in rows), key=str)

    names = ("doc_id", "n_bytes", "n_tokens", "over_limit")
    assert rows_of(Q.op5_tokens(spark, sf), *names) == plain(docs)
    odd = [*EDGE, (20, "<|endoftext|>"), (21, "a<|startoftext|>b <|endoftext|><|endoftext|> don't I'LL"), (22, "<|endof text|>"), (23, " x y​z"), (24, "don 't"), (25, "á é\ń"), (26, "12 345 六七"), (27, "x 'll　y")]
    frame = spark.createDataFrame(odd, "doc_id long, text string")
    assert rows_of(token_counts(frame, path), *names) == plain(odd)
    assert token_counts(empty, path).count() == 0


def test_substring(spark, sf, docs, edge, empty):
    from glossmill.llm.substring import dedup_substrings

    names = ("doc_id", "n_words", "n_removed", "kept_sha256")
    assert rows_of(Q.op6_substring(spark, sf), *names) == brute.substring(docs)
    assert rows_of(dedup_substrings(edge), *names) == brute.substring(EDGE)
    assert dedup_substrings(empty).count() == 0


@pytest.mark.parametrize("share", [0.0, 1.0])
def test_substring_of_few_words(spark, share):
    """A small vocabulary, so that windows overlap, repeat within documents and share anchors; all cells crowded, or none."""
    from glossmill.llm.substring import dedup_substrings

    rng = random.Random(5)
    seeds = [[rng.choice("abc") for _ in range(40)] for _ in range(6)]
    rows = [(i // 2 * 2 if i < 20 else i if i < 57 else None, " ".join(w for _ in range(rng.randint(0, 4)) for w in rng.choice(seeds)[rng.randint(0, 20) :])) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(dedup_substrings(frame, crowded_share=share), "doc_id", "n_words", "n_removed", "kept_sha256") == brute.substring(rows)


@pytest.mark.parametrize("share", [0.0, 1.0])
def test_substring_of_passages_repeated_within_documents(spark, share):
    from glossmill.llm.substring import dedup_substrings

    said = [" ".join(f"s{k}w{i}" for i in range(13 + 5 * k)) for k in range(3)]
    rows = [(d, " ".join(f"{said[(d + i) % 3 if d % 4 else 0]} d{d}i{i}" for i in range(40 + d))) for d in range(8)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert rows_of(dedup_substrings(frame, crowded_share=share), "doc_id", "n_words", "n_removed", "kept_sha256") == brute.substring(rows)


@pytest.mark.parametrize("copies", [2, 5])
@pytest.mark.parametrize("at_once", [20, 1_500_000])
def test_substring_of_copies_that_repeat_themselves(spark, copies, at_once):
    """A piece may be full while all its later passages were settled as equal ones; pieces of one key, too."""
    from glossmill.llm.substring import dedup_substrings

    rng = random.Random(3)
    text = " ".join(rng.choice("abcdefgh") for _ in range(30_000))
    rows = [(i, text) for i in range(copies)] + [(90, "x " * 40 + text[:2_000]), (2**63 - 1, text[:500]), (None, "y " * 30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for share in (0.0, 1.0):
        found = dedup_substrings(frame, crowded_share=share, words_at_once=at_once)
        assert rows_of(found, "doc_id", "n_words", "n_removed", "kept_sha256") == brute.substring(rows)


def test_same_words():
    import numpy as np
    import pyarrow as pa

    from glossmill.llm import words as W
    from glossmill.llm.substring import _same_words

    words = W.split(pa.array(["a bb c a bb c a bx c", "a bb c"]))
    assert _same_words(words, np.array([0, 0, 0, 3]), np.array([3, 6, 9, 3]), 3).tolist() == [True, False, True, True]
    assert not len(_same_words(words, np.array([], int), np.array([], int), 3))


@pytest.mark.parametrize("share", [0.0, 1.0])
def test_substring_tells_words_with_equal_half_hashes_apart(spark, share):
    """Words whose 64-bit hashes agree in their lower or upper 32 bits, in documents equal but for them."""
    import numpy as np
    import pyarrow as pa

    from glossmill.llm import words as W
    from glossmill.llm.substring import dedup_substrings

    made = [f"q{i}" for i in range(400_000)]
    h = W.hashes(W.split(pa.array(made)))
    rows = []
    for part in (h & np.uint64(0xFFFFFFFF), h >> np.uint64(32)):
        order = np.argsort(part)
        for i in np.flatnonzero(part[order][1:] == part[order][:-1])[:6]:
            for word in (made[order[i]], made[order[i + 1]]):
                rows.append((len(rows), " ".join([*(f"c{len(rows) // 2}x{j}" for j in range(12)), word])))
    assert len(rows) >= 12
    for r in dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), crowded_share=share).collect():
        assert (r.n_words, r.n_removed) == (13, 0)


def test_matching_statistics():
    """Lengths and least values against a plain search, with words that the index lacks."""
    import numpy as np

    from glossmill.llm.fmindex import FMIndex, coded

    rng = random.Random(1)
    for depth in (3, 5, 13):
        for names in (2, 3, 40):
            word = lambda extra: rng.choice([f"w{i}" for i in range(names + extra)])
            indexed, asked = ([[word(x) for _ in range(rng.randint(1, 40))] for _ in range(9)] for x in (0, 1))
            asked += indexed[:2]
            values = np.array([rng.randint(0, 99) for _ in indexed])
            words, at, _ = coded([" ".join(p).encode() for p in indexed + asked])
            k = len(indexed)
            index = FMIndex(words[: at[k]], at[: k + 1], values, depth)
            got = zip(*(x.tolist() for x in index.matching_statistics(words[at[k] :], at[k:] - at[k])))
            for s in asked:
                for i in range(len(s)):
                    agree = [(next((m for m in range(depth) if s[i + m : i + m + 1] != p[j + m : j + m + 1] or i + m >= len(s)), depth), v) for p, v in zip(indexed, values.tolist()) for j in range(len(p))]
                    assert next(got) == (max(m for m, _ in agree), min((v for m, v in agree if m == depth), default=2**63 - 1))


def test_decontam(spark, sf, docs, edge, empty):
    from glossmill.llm.decontam import decontaminate

    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert rows_of(Q.op8_decontam(spark, sf), *names) == brute.decontam(docs, items)
    few = [(1, LONG), (2, "a b"), (3, None), (4, " ".join(OTHER.split()[5:25])), (5, LONG), (6, "W1 w2, w3"), (7, " ... "), (8, "w59 tail")]
    bench = spark.createDataFrame(few, "item_id long, text string")
    assert rows_of(decontaminate(edge, bench), *names) == brute.decontam(EDGE, few)
    assert decontaminate(edge, bench.where("false")).where("contaminated").count() == 0
    assert decontaminate(empty, bench).count() == 0


def test_decontam_of_one_word_items(spark):
    """Items of one very common word, many with the same words, and documents full of them."""
    from glossmill.llm.decontam import decontaminate

    ten = " ".join(f"t{i}" for i in range(14))
    items = [(f"i{i}", "Yes") for i in range(40)] + [("no", "no"), ("a", ten), ("b", ten + " end"), ("c", ""), ("d", None), (None, "yes")]
    docs = [(i, "yes " * (i % 90) + (ten if i % 3 else "no")) for i in range(300)]
    bench, frame = spark.createDataFrame(items, "item_id string, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    found = decontaminate(frame, bench)
    assert rows_of(found, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == brute.decontam(docs, [i for i in items if i[0] is not None])


def plain_warc(rows, least=0):
    first = {}
    for page, html in rows:
        data = (html or "").encode()
        if len(data) >= least:
            first[data] = min(first.get(data, page), page)
    digest = lambda d: base64.b32encode(hashlib.sha1(d).digest()).decode()
    out = []
    for page, html in rows:
        data = (html or "").encode()
        of = first.get(data, page)
        out.append((page, len(data), digest(data), "response" if of == page else "revisit", None if of == page else of))
    return sorted(out, key=str)


def test_warc(spark, sf):
    from glossmill.llm.scratch import scratch_dir
    from glossmill.llm.warc import read_warc, write_warc

    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert rows_of(Q.op9_warc(spark, sf), *names) == plain_warc([(r.page_id, r.html) for r in pages.collect()])
    odd = [(i, "http://x/ y\r\nz" if i % 2 else None, None if i % 11 == 0 else "é" * (i % 4) if i % 3 else f"<p>{i}</p>" * 300) for i in range(200)]
    frame = spark.createDataFrame([(*r, 1, "k") for r in odd], "page_id long, url string, html string, first int, key string")
    out = [scratch_dir(spark) for _ in range(2)]
    made = [{r.name: r.sha1 for r in write_warc(x, o, roll_bytes=2_000).collect()} for x, o in zip((frame, frame.repartition(3)), out)]
    assert made[0] == made[1] and len(made[0]) > 8
    assert rows_of(read_warc(spark, out[0]), *names) == plain_warc([(p, h) for p, _, h in odd])
    back = {r.page_id: bytes(r.payload) for r in read_warc(spark, out[0]).where("record_type = 'response'").collect()}
    said = {p: (h or "").encode() for p, _, h in odd}
    assert back == {p: said[p] for p, _, _, kind, _ in plain_warc([(p, h) for p, _, h in odd]) if kind == "response"}
    few = scratch_dir(spark)
    write_warc(frame, few, min_payload=10)
    assert rows_of(read_warc(spark, few), *names) == plain_warc([(p, h) for p, _, h in odd], 10)


def test_warc_repeated_and_unnamed_rows(spark):
    from glossmill.llm.scratch import scratch_dir
    from glossmill.llm.warc import read_warc, write_warc

    frame = spark.createDataFrame([(1, "u", "a"), (1, "u", "a"), (None, "u", "a"), (None, "u", "b"), (2, "u", "c")], "page_id long, url string, html string")
    out, none = scratch_dir(spark), scratch_dir(spark)
    write_warc(frame, out)
    got = rows_of(read_warc(spark, out), "page_id", "record_type", "refers_to")
    assert got == sorted([(1, "response", None), (1, "revisit", 1), (None, "revisit", 1), (None, "response", None), (2, "response", None)], key=str)
    assert write_warc(frame.where("false"), none).count() == 0
    assert read_warc(spark, none).count() == 0


def test_warc_of_extreme_ids_long_pages_and_one_common_payload(spark):
    """The largest id is an id; most pages are empty; a page of three million characters."""
    from glossmill.llm.scratch import scratch_dir
    from glossmill.llm.warc import read_warc, write_warc

    top = 2**63 - 1
    rows = [(i, "") for i in range(1, 600)] + [(top, ""), (-top - 1, "z"), (top, "z"), (0, "long é " * 400_000), (None, "z"), (None, "only"), (top, "only")]
    out = scratch_dir(spark)
    write_warc(spark.createDataFrame([(p, "u", h) for p, h in rows], "page_id long, url string, html string").repartition(5), out)
    got = {(r.page_id, r.payload_bytes): (r.record_type, r.refers_to) for r in read_warc(spark, out).collect()}
    assert got[1, 0] == ("response", None) and all(got[i, 0] == ("revisit", 1) for i in [*range(2, 600), top])
    assert got[-top - 1, 1] == ("response", None) and got[top, 1] == got[None, 1] == ("revisit", -top - 1)
    assert got[top, 4] == ("response", None) and got[None, 4] == ("revisit", top) and got[0, 8 * 400_000] == ("response", None)


def auc(rows, label):
    good, bad = ([s for i, s in rows if label[i] == k] for k in (1, 0))
    return sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))


@pytest.mark.parametrize("name, column, least", [("op7_toxicity", "toxic", 0.85), ("op10_quality", "quality", 0.9)])
def test_classifiers(spark, sf, name, column, least):
    at = sf.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r[column] for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    rows = Q.QUERIES[name](spark, at).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert auc([(r.doc_id, r.score) for r in rows if r.held_out and r.doc_id in labels], labels) >= least


@pytest.mark.parametrize("module, function, column", [("toxicity", "score_toxicity", "toxic"), ("quality", "score_quality", "quality")])
def test_classifiers_on_odd_rows(spark, edge, empty, module, function, column):
    import importlib

    score = getattr(importlib.import_module(f"glossmill.llm.{module}"), function)
    known = spark.createDataFrame([(i, i % 2) for i in range(1, 14)] + [(99, 1), (None, 1), (5, None), (1, 1)], f"doc_id long, {column} int")
    for labels in (known, known.where("false"), known.where(f"{column} = 1")):
        got = score(edge, labels).collect()
        assert sorted((r.doc_id for r in got), key=str) == sorted((d for d, _ in EDGE), key=str)
        assert all(0 <= r.score <= 1 for r in got)
        assert all(len({r.score for r in got if r.doc_id == d}) == 1 for d in (2, 4, 5, 6))
    assert score(empty, known).count() == 0


def test_pipeline(spark, sf):
    """Each stage against the plain versions, on what the one before kept; the query gives the same rows."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    toxic = {r.doc_id for r in Q.op7_toxicity(spark, sf).where("predicted = 1").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in P.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        sources = {r.doc_id: (r.source, len(brute.words(r.text))) for r in docs.collect()}
        made = stage(spark, docs, sf)
        docs = spark.createDataFrame(made.collect(), made.schema)
        after = {r.doc_id: r.text for r in docs.collect()}
        assert len(after) == docs.count() and (name == "mixing" or docs.columns == columns)
        if name == "toxicity":
            assert after == {d: t for d, t in before if d not in toxic}
        elif name == "near_duplicates":
            assert after == {d: t for d, t in before if (d, d) in {(x, c) for x, _, c in brute.jaccard(before)}}
        elif name == "repeated_passages":
            cut = {d: (n, gone) for d, n, gone, _ in brute.substring(before)}
            assert set(after) == {d for d, (n, gone) in cut.items() if not n or gone < n}
            assert all(len(brute.words(after[d])) == cut[d][0] - cut[d][1] for d in after)
            assert all(r.n_chars == len(r.text) for r in docs.collect() if cut[r.doc_id][1])
        elif name == "benchmark_leaks":
            assert set(after) == {d for d, *_, hit in brute.decontam(before, items) if not hit}
        else:
            rows = docs.collect()
            assert all(after[d] == t for d, t in before if d in after) and all(r.n_copies > 0 and r.taken == r.n_copies * r.size for r in rows)
            goals = brute.targets({s: sum(n for t, n in sources.values() if t == s) for s in {t for t, _ in sources.values()}})
            for s, goal in goals.items():
                assert abs(sum(r.taken for r in rows if r.source == s) - goal) <= max(n for t, n in sources.values() if t == s)
    assert [n for n, _ in P.STAGES][-1] == "mixing"


def test_pipeline_leaves_tables_of_others(spark, sf):
    """What a query has made before a run of the pipeline can be read after it, and the run leaves one table."""
    import os

    import corpus_pipeline as P
    from glossmill.llm.scratch import drop_all, scratch_dir

    before = Q.op4_mix(spark, sf)
    folder = os.path.dirname(scratch_dir(spark))
    had = set(os.listdir(folder))
    after = P.run(spark, sf)
    assert before.count() and after.count() and len(set(os.listdir(folder)) - had) == 1
    drop_all(spark)
    assert not os.path.exists(folder)


def test_pipeline_decides_by_row(spark, tmp_path):
    """Null and repeated doc_ids, null and empty texts, extra columns and an empty table, stage by stage."""
    import corpus_pipeline as P

    clean = [" ".join(f"{k}word{i}" for i in range(40)) for k in "abcdef"]
    near = clean[0] + " tail"
    leak = " ".join(f"leak{i}" for i in range(12))
    rows = [
        (1, clean[0]), (2, near), (2, clean[1]), (None, clean[2]), (None, clean[0]), (3, None), (3, ""), (4, clean[3]), (4, clean[3]),
        (5, clean[4] + " " + leak), (5, clean[5]), (None, leak), (6, " \t"),
    ]
    frame = spark.createDataFrame([(d, t, "en", "s", len(t or ""), 9, "k", 1.5) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, sig long, row string, size double")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 0), (2, 1), (None, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    pairs = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    stages = dict(P.STAGES)
    got = stages["near_duplicates"](spark, frame, str(tmp_path))
    assert got.columns == frame.columns
    assert pairs(got) == sorted(set(rows) - {(2, near)}, key=str)
    got = stages["benchmark_leaks"](spark, frame, str(tmp_path))
    assert got.columns == frame.columns
    assert pairs(got) == sorted((r for r in rows if leak not in (r[1] or "")), key=str)
    got = stages["repeated_passages"](spark, frame, str(tmp_path))
    assert got.columns == frame.columns
    lost = {(2, near): None, (None, clean[0]): None, (None, leak): None}  # what is left of the near copy is under a word of its own
    expected = sorted(((d, "tail" if t == near else t) for d, t in rows if (d, t) not in lost or t == near), key=str)
    assert [r for r in pairs(got) if r[1] != leak] == [r for r in expected if r[1] != leak]
    got = stages["mixing"](spark, frame, str(tmp_path))
    assert set(pairs(got)) <= set(rows) and all(r.size == len(brute.words(r.text)) and r.row == "k" for r in got.collect())
    assert sum(r.taken for r in got.collect()) == pytest.approx(sum(len(brute.words(t)) for _, t in rows), abs=60)
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet").where("toxic = 0")
    labels.write.parquet(f"{tmp_path}/none/labels.parquet")
    got = stages["toxicity"](spark, frame, f"{tmp_path}/none")
    assert got.columns == frame.columns and pairs(got) == sorted(rows, key=str)
    for name, stage in P.STAGES:
        assert stage(spark, frame.where("false"), str(tmp_path)).count() == 0, name


def test_held_out_rows_and_labels(spark):
    """``held_out`` follows crc32; held-out labels, lang and source never move a score; few labels and repeated doc_ids give results."""
    import zlib

    from glossmill.llm.quality import score_quality
    from glossmill.llm.toxicity import score_toxicity

    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(("idiot fool stupid" if i % 3 == 0 else "kind warm plain").split()) + str(rng.randrange(9)) for _ in range(30)), "en", f"s{i % 4}") for i in range(90)]
    docs += [(5, "another text of the same id", "de", "t")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    for score, column, fold in ((score_toxicity, "toxic", (4, 2)), (score_quality, "quality", (5, 0))):
        out = lambda i: zlib.crc32(str(i).encode()) % fold[0] == fold[1]  # noqa: E731, B023
        labels = [(i, int(i % 3 == 0)) for i in range(90)]
        frames = [spark.createDataFrame(x, f"doc_id long, {column} int") for x in (labels, [(i, 1 - y if out(i) else y) for i, y in labels])]
        one = score(frame, frames[0]).collect()
        assert all(r.held_out == out(r.doc_id) for r in one)
        key = lambda rows: sorted((r.doc_id, round(r.score, 9)) for r in rows)
        assert key(one) == key(score(frame.withColumn("lang", F.lit("x")).withColumn("source", F.lit("y")).repartition(3), frames[1]).collect())
        few = spark.createDataFrame([(1, "a b c"), (2, "d e f"), (3, "")], "doc_id long, text string")
        for some in ([(1, 1)], [(2, 1)], [(1, 1), (2, 0)], [(3, 0)], [(1, 0), (2, 0), (3, 0)]):
            got = score(few, spark.createDataFrame(some, f"doc_id long, {column} int")).collect()
            assert len(got) == 3 and all(0 <= r.score <= 1 for r in got)


def test_isotonic_and_ridge():
    import numpy as np

    from glossmill.llm.quality import _solve, isotonic

    rng = np.random.default_rng(4)
    raw, y = rng.integers(0, 12, 60).astype(float), rng.integers(0, 2, 60).astype(float)
    keys = np.unique(raw)
    mean = {k: (y[raw == k].mean(), (raw == k).sum()) for k in keys}
    # the least-squares fit that never falls: max over starts of min over ends of the means between
    plain = [max(min(np.average([mean[k][0] for k in keys[a : b + 1]], weights=[mean[k][1] for k in keys[a : b + 1]]) for b in range(i, len(keys))) for a in range(i + 1)) for i in range(len(keys))]
    x, share = isotonic(raw, y)
    assert sorted({round(p, 12) for p in plain}) == [round(s, 12) for s in share]
    z, t = rng.normal(size=(40, 5)), rng.normal(size=40)
    w = _solve(z.T @ z, z.T @ t, 40, 0.1)
    assert np.allclose(z.T @ (z @ w - t) + 0.1 * 40 * w, 0)
    assert not _solve(np.zeros((5, 5)), np.zeros(5), 0, 0.1).any()


def test_tokens_by_shuffle_and_refusals(spark, edge):
    """The same counts when hardly a pre-token is held by the tasks; vocabularies that cross white space are refused."""
    from glossmill.llm.tokens import token_counts

    path = Q.tokenizer_path()
    names = ("doc_id", "n_bytes", "n_tokens", "over_limit")
    assert rows_of(token_counts(edge, path, held=3), *names) == rows_of(token_counts(edge, path), *names)
    with pytest.raises(ValueError):
        token_counts(edge, Q.tokenizer_path("byte_bpe_50k.json"))
