import hashlib
import itertools
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgersift.llm import alignment, hard_negatives, line_dedup

LONG = "This line says the same in each of them, no more"


# --- lines ----------------------------------------------------------------------------------------


def brute_lines(rows, least_chars=40, least_docs=5):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    order = lambda d: -(2**63) if d is None else d
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders[key(line)].add(order(d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(holders.get(key(x), ())) >= least_docs and max(holders[key(x)]) != order(d))]
        out.append((d, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def found_lines(df, **options):
    return sorted(map(tuple, line_dedup.dedup_lines(df, **options).collect()), key=str)


def test_lines_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    pool = [f"{'Ä' * (i % 3)}line number {i} of a pool of lines that repeat {'x' * (i % 17)}" for i in range(30)]
    pool += ["short", "", "É" * 39, "É" * 40, "é" * 40, "\x0b" + LONG.upper() + " \t", LONG, " " + LONG, "ends with \r" * 5]
    rows = [(int(i), "\n".join(pool[j] for j in rng.integers(0, len(pool), rng.integers(1, 9)))) for i in range(60)]
    rows += [(7, LONG), (7, LONG + "\n" + LONG), (None, LONG), (None, None), (99, None), (98, ""), (97, "\n\n"), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h1", F.lit("clash")).withColumn("gone", F.lit(1))
    assert found_lines(df.repartition(5)) == brute_lines(rows)
    assert found_lines(df, least_chars=1, least_docs=2) == brute_lines(rows, 1, 2)


def test_one_line_in_all_documents_is_probed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 3)
    probe = line_dedup.probe_shards
    monkeypatch.setattr(line_dedup, "probe_shards", lambda *a: probe(*a, entries=10))
    rows = [(i, f"{LONG}\n{i % 9} of several lines that come back in a ninth of them all") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_lines(df) == brute_lines(rows)


def test_very_long_text_and_empty_table(spark):
    long = "\n".join([LONG] * 40000 + ["w" * 3_000_000])
    rows = [(i, LONG) for i in range(5)] + [(9, long), (10, long + "x")]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[9]["n_dropped"], got[10]["n_dropped"], got[4]["n_dropped"]) == (40000, 0, 1)
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(spark.createDataFrame(rows[:1], "doc_id long, text string"), least_docs=1)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 64, 5000])
def test_hash_is_minimal_and_perfect(n):
    words = np.random.default_rng(n).integers(0, 2**63, (n, 2)).astype(np.uint64)
    sizes, bits = line_dedup.build_levels(words)
    assert sorted(line_dedup.find_slots(words, sizes, bits)) == list(range(n))


# --- hard negatives -------------------------------------------------------------------------------


def brute_negatives(rows, every=100, least=80):
    good = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        good.append((i, label, [int(np.floor(256 * float(x))) for x in v]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a, label, v in {(i, lab, tuple(v)) for i, lab, v in good if i % every == 0}:
        same = sorted((-dot(v, w), i) for i, lab, w in good if lab == label and i != a)[:5]
        for p, pos in same:
            fit = sorted((-dot(v, w), i) for i, lab, w in good if lab != label and -least * p <= 100 * dot(v, w) <= -100 * p)
            out += [(a, pos, k + 1, n, -p, -s) for k, (s, n) in enumerate(fit[:5])]
    return sorted(out)


def mined(spark, rows, every=100, **options):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("angles", F.lit("clash")).withColumn("id", F.lit(3))
    return sorted(map(tuple, hard_negatives.mine_hard_negatives(df, F.col("vec_id") % every == 0, F.col("label"), **options).collect()))


def test_negatives_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 12))
    rows = [(i, int(i % 3), (centres[i % 6] + 0.3 * rng.normal(size=12)).tolist()) for i in range(700)]
    rows += [(800 + i, i % 3, rows[5][2]) for i in range(6)]  # ties
    rows += [rows[100], (100, 2, rows[3][2]), (900, 1, [0.0] * 12), (901, None, [1.0] * 12), (902, 1, None), (None, 1, [1.0] * 12)]
    rows += [(1000, 1, [float("nan")] * 12), (1100, 1, [float("inf")] + [0.0] * 11), (1200, 1, [None] * 12), (1300, 0, [1.0, 2.0]), (1400, 0, [])]
    for references in (0, 1, 16):
        assert mined(spark, rows, references=references) == brute_negatives(rows)


def test_negatives_over_blocks_and_slices(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 7)
    monkeypatch.setattr(hard_negatives, "SLICE_ROWS", 50)
    rng = np.random.default_rng(3)
    rows = [(i, 0 if i % 3 else i % 5, rng.normal(size=5).tolist()) for i in range(400)]
    assert mined(spark, rows, every=10) == brute_negatives(rows, every=10)


def test_negatives_of_large_components_and_of_nothing(spark):
    rows = [(i, i % 2, [1e5 * (i + 1), 3e6 - i]) for i in range(40)]
    assert mined(spark, rows, every=20) == brute_negatives(rows, every=20)
    assert mined(spark, rows[:0]) == []
    assert mined(spark, [(100, 1, [1.0])]) == []


def test_bounds_hold_and_windows_prune():
    rng = np.random.default_rng(4)
    vectors = np.concatenate([rng.integers(-20, 20, (200, 8)) + 300 * np.eye(8, dtype=int)[k % 8] for k in range(8)])
    references = hard_negatives.choose_references(vectors, 8)
    norms, angles = hard_negatives.angles_to(vectors, references)
    w = hard_negatives.Windows(np.arange(len(vectors)), np.zeros(len(vectors), int), vectors, norms, angles)
    lower, upper = hard_negatives.score_bounds(norms, angles, w.least, w.most, w.low, w.high)
    for k in range(len(w.starts)):
        scores = vectors @ w.vectors[w.starts[k]:w.ends[k]].T
        assert (scores.min(axis=1) >= lower[:, k]).all() and (scores.max(axis=1) <= upper[:, k]).all()
    assert (upper[0] < 60000).mean() > 0.7  # the score of near vectors is some 90000


# --- alignment ------------------------------------------------------------------------------------


def brute_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a_model = Tokenizer.from_file(f"{alignment.TOKENIZERS}/byte_bpe_50k.json")
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=f"{alignment.TOKENIZERS}/piece_bpe_32k.model")
    letters, count, held, out = alignment._byte_letters(), Counter(), [], []
    for doc_id, text in texts:
        raw = (" " + (text or "")).encode()
        a = a_model.encode(raw.decode(), add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        a_bytes = [bytes(letters[c] for c in a_model.id_to_token(i)) for i in a]
        b_bytes = [alignment._piece_bytes(b_model.id_to_piece(i)) for i in b]
        if not text or b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
            out.append([doc_id, 0, 0, 0, 0, 0, 0, ""])
            held.append([])
            continue
        a_end, b_end = (list(itertools.accumulate(map(len, s))) for s in (a_bytes, b_bytes))
        of_a = [k for k, s in enumerate(a_bytes) for _ in s]
        of_b = [k for k, s in enumerate(b_bytes) for _ in s]
        links = [(a[i], b[j]) for i, j in sorted(set(zip(of_a, of_b, strict=True)))]
        groups, i, j = [], 0, 0
        for cut in sorted(set(a_end) & set(b_end)):
            i2, j2 = a_end.index(cut) + 1, b_end.index(cut) + 1
            groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
            i, j = i2, j2
        count.update(set(links))
        held.append(links)
        out.append([doc_id, len(a), len(b), len(groups), len(links), 0, 0, hashlib.sha256(";".join(groups).encode()).hexdigest()])
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    for row, links in zip(out, held, strict=True):
        row[5], row[6] = sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links)
    return sorted(map(tuple, out), key=str)


HARD = [
    "plain words, and some more of them", "naïve café über straße", "日本語の文章です。", "emoji 👩‍👩‍👧 and more 🎉", "tabs\tand\nlines\r\n  of text  ",
    "<|endoftext|> and <s> are text </s> here", "a piece mark ▁ in a text", " starts with a blank", "   ", "\x00\x01 control", "x", None, "",
    "don't can't I'll we've", "1234567890 0xFF 3.14159", "a b  c   d    e", "    odd 　 blanks", "é combining",
]


def aligned(spark, texts, **options):
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("n", F.lit(1))
    return sorted(map(tuple, alignment.align_tokens(df, **options).collect()), key=str)


def test_alignment_equals_brute_force(spark):
    words = " ".join(t for t in HARD if t).split()
    rng = np.random.default_rng(9)
    texts = list(enumerate(HARD)) + [(50 + i, " ".join(rng.choice(words, 80))) for i in range(12)]
    texts += [(50, "again the same id"), (50, "again the same id"), (None, "no id"), (70, "nospace" * 40), (71, "long " + "ü" * 200 + " end")]
    want = brute_alignment(texts)
    assert aligned(spark, texts) == want
    for chars, fan_in in ((7, 2), (40, 3)):
        assert aligned(spark, texts, chars=chars, fan_in=fan_in) == want
    assert aligned(spark, []) == []


def test_long_runs_of_blanks_and_one_word(spark):
    texts = [(1, "a" + " " * 5000 + "b"), (2, "z" * 60000), (3, "ab cd " * 20000)]
    assert aligned(spark, texts, chars=1000) == brute_alignment(texts)


def test_fragments_compose_in_any_order():
    voc = alignment.vocabularies(f"{alignment.TOKENIZERS}/byte_bpe_50k.json", f"{alignment.TOKENIZERS}/piece_bpe_32k.model")
    text = "größere Sätze zerfallen anders; naïve tokenizers disagree about 日本 and 1234567"
    parts = [alignment.read_range(voc, *r) for r in alignment.cut_ranges(text, 5)]
    assert any(not p.closed for p in parts) and any(p.suffix for p in parts)
    whole = alignment.finish(voc, alignment.read_range(voc, *next(alignment.cut_ranges(text, 1000))))

    def fold(items):
        if len(items) == 1:
            return items[0]
        k = fold.rng.integers(1, len(items))
        return alignment.compose(voc, fold(items[:k]), fold(items[k:]))

    for seed in range(20):
        fold.rng = np.random.default_rng(seed)
        done = alignment.finish(voc, fold([alignment.Fragment(), *parts, alignment.Fragment()]))
        assert (done.shown, done.n_a, done.n_b, done.n_groups, done.n_links) == (whole.shown, whole.n_a, whole.n_b, whole.n_groups, whole.n_links)
        assert done.keys.tolist() == whole.keys.tolist() and done.times.tolist() == whole.times.tolist()
