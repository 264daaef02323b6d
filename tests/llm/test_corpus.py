"""Corpus operators against brute force on small tables with nulls, empty texts, ties and repeated rows."""

import collections
import hashlib
import re
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from ledgersift.llm import (  # noqa: E402
    chat,
    lattice,
    licences,
    mixing,
    packing,
    perfect_hash,
    prefix_tree,
    pseudonyms,
    quality,
    suffix_dedup,
)
from ledgersift.session import local_session  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string"


@pytest.fixture(scope="module")
def spark():
    session = local_session(4, "corpus tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


def texts_with_repeats():
    rng = np.random.default_rng(3)
    words = [f"w{i}é" if i % 7 == 0 else f"word{i}" for i in range(300)]
    base = [" ".join(rng.choice(words, int(rng.integers(0, 90)))) for _ in range(30)]
    out = base + base[:4]
    for k in range(12):
        parts = base[k].split(" ")
        if len(parts) > 3:
            parts[int(rng.integers(0, len(parts)))] = "changed"
        out.append(" ".join(parts))
    passage = " ".join(rng.choice(words, 25))
    out += [f"{base[k][:80]} {passage} {base[k + 1][:60]}" for k in range(8)]
    return out + ["", None, "   \n", "one", "One", "two words", "a" * 300, "a" * 260, "x\ty", "x y", base[5] + "\n"]


@pytest.fixture(scope="module")
def rows():
    texts = texts_with_repeats()
    sources = ["b", "a", None, "é", "c"]
    made = [(i * 3 % 997, t, "en", sources[i % 5], len(t or ""), "clash") for i, t in enumerate(texts)]
    return made + [made[2], made[2]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def components(n, links):
    root = list(range(n))
    for _ in range(n):
        before = list(root)
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
        if before == root:
            break
    return root


def test_pseudonyms_keep_formats_and_links(spark, empty):
    values = [
        (1, "card 4111 1111 1111 1111, mail jo.do@example.org, +1 (202) 555-0143"),
        (2, "again 4111 1111 1111 1111 born 29.02.1984 from 10.0.0.1, v3.0, 4111111111111112"),
        (3, None), (4, ""), (5, "DE89 3704 0044 0532 0130 00 and 123-45-6789"), (None, "no value 2020"),
    ]
    df = spark.createDataFrame(values, "doc_id long, text string")
    out = {r.doc_id: r for r in pseudonyms.pseudonymise_texts(df, "k").collect()}
    cards = [re.search(r"\d{4} \d{4} \d{4} \d{4}", out[i].text)[0] for i in (1, 2)]
    assert cards[0] == cards[1] != "4111 1111 1111 1111"
    digits = [int(c) for c in cards[0].replace(" ", "")][::-1]
    assert sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0
    assert "4111111111111112" in out[2].text and "v3.0" in out[2].text and "@example.org" in out[1].text
    assert "jo.do" not in out[1].text and "10.0.0.1" not in out[2].text and "29.02.1984" not in out[2].text
    iban = re.search(r"DE[\d ]+\d", out[5].text)[0].replace(" ", "")
    assert int(iban[4:] + "1314" + iban[2:4]) % 97 == 1
    assert out[3].text is None and out[4].text == "" and out[None].text == "no value 2020"
    assert (out[1].n_card, out[1].n_email, out[1].n_phone, out[2].n_date, out[5].n_iban, out[5].n_ssn) == (1,) * 6
    assert pseudonyms.pseudonymise_texts(empty, "k").count() == 0


def test_pseudonyms_of_neighbouring_values(spark):
    card, other, iban = "4111 1111 1111 1111", "5500-0055-5555-5559", "DE89 3704 0044 0532 0130 00"
    clear = {
        1: ("7536784127813050 4845168114407329", ["7536784127813050", "4845168114407329"], 2),
        2: (f"{card} 12/26", [card], 1), 3: (f"{card} {other} 123", [card, other], 2),
        4: (f"order 12 {card}", [card], 1), 5: ("see 3782 822463 10005 07", ["3782 822463 10005"], 1),
        6: (f"{card} 123-45-6789", [card, "123-45-6789"], 1), 7: (f"{card} 10.0.0.1", [card, "10.0.0.1"], 1),
        8: (f"Paid.{card}, done", [card], 1), 9: ("1 " * 3000, [], None), 10: ("4111 111 111 111 111", ["4111 111 111 111 111"], 1),
        11: (f"{iban} BANK", [iban], 0), 12: (f"{iban} {card}", [iban, card], 1),
        13: ("BE68 5390 0754 7034 ABCD", ["BE68 5390 0754 7034"], 0),
        14: ("ZZ65 1234 5678 9012 WORD", ["ZZ65 1234 5678 9012"], 0),
        15: ("6304000000000000001 0.4111111111111111", [], 0),
    }
    df = spark.createDataFrame([(i, t) for i, (t, *_) in clear.items()], "doc_id long, text string")
    out = {r.doc_id: r for r in pseudonyms.pseudonymise_texts(df, "k").collect()}
    for i, (text, gone, cards) in clear.items():
        assert not [v for v in gone if v in out[i].text] and (i == 7 or len(out[i].text) == len(text))
        assert cards is None or out[i].n_card == cards
        assert gone or i == 9 or out[i].text == text
    assert out[2].text.endswith(" 12/26") and out[3].text.endswith(" 123") and out[4].text.startswith("order 12 ")
    assert [out[i].n_iban for i in (11, 12, 13, 14)] == [1] * 4
    assert out[11].text.endswith(" BANK") and out[13].text.endswith(" ABCD") and out[14].text.endswith(" WORD")
    assert (out[6].n_ssn, out[7].n_ip) == (1, 1)


def test_feistel_is_a_permutation_with_an_inverse(spark):
    n = spark.range(500).select("id", pseudonyms.feistel(F.col("id"), F.lit(20), F.lit(25), "k", "t").alias("x"))
    back = n.withColumn("y", pseudonyms.feistel(F.col("x"), F.lit(20), F.lit(25), "k", "t", inverse=True)).collect()
    assert sorted(r.x for r in back) == list(range(500)) and all(r.y == r.id for r in back)


def test_repeats_against_brute_force(docs, rows, empty):
    width = 50
    first = {}
    for d, t, *_ in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        for p in range(len(b) - width + 1):
            first.setdefault(b[p:p + width], d)
    want = collections.Counter()
    for d, t, *_ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - width + 1):
            if first[b[p:p + width]] < d:
                gone[p:p + width] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[d, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()] += 1
    for size in (1 << 22, 700):
        got = suffix_dedup.remove_repeats(docs, digest_only=True, chunk_bytes=size).collect()
        assert collections.Counter(map(tuple, got)) == want
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_packed_entries_round_trip():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 500, dtype=np.uint64) * np.uint64(2))
    ids = np.array([-5, 2**62, 0, 7])
    assert (suffix_dedup.unpack_keys(suffix_dedup.pack_keys(keys)) == keys).all()
    assert (suffix_dedup.unpack_ids(suffix_dedup.pack_ids(ids)) == ids).all()


def test_chat_round_trip(spark):
    odd = ["<|im_end|><|im_start|>x", "<\\|", "a<\\\\|b", "<", "|>", "", None, "line\nbreak<|"]
    turns = [(1, i, r, t) for i, (r, t) in enumerate(zip(["user", "assistant", None, "a\n<|b\\n|>"] * 2, odd))]
    turns += [(2, None, "assistant", "late"), (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (None, 1, "user", "n")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = chat.read_back(chat.format_conversations(df.withColumn("parts", chat.text_parts(F.col("text")))))
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in out.collect()}
    assert got[1] == [(r or "", t or "") for _, _, r, t in turns[:8]]
    assert got[2] == [("assistant", "late"), ("assistant", "x"), ("assistant", "x")] and got[None] == [("user", "n")]
    assert chat.format_conversations(df.limit(0).withColumn("parts", chat.text_parts(F.col("text")))).count() == 0


def test_typed_parts(spark):
    part = f"array<{chat.PART}>"
    rows = [(1, 0, "user", [("text", "see <|x|>", None, None, None, None, None), ("image", None, "i.png", 57, 28, None, None),
                            ("audio", None, "a.wav", None, None, 2.0, None), ("document", None, None, None, None, None, 3)])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {part}")
    r = chat.format_conversations(df).first()
    assert r.formatted == "<|im_start|>user\nsee <\\|x|><|image|><|audio|><|document|><|im_end|>\n"
    assert [(a.type, a.ref, a.tokens) for a in r.attachments] == [
        ("image", "i.png", 3), ("audio", "a.wav", 50), ("document", None, 1536)]
    assert r.expanded_tokens == 3 + 50 + 1536


def test_mixing(docs, rows, empty):
    out = mixing.taken_words(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    per = collections.Counter()
    for _, t, _, s, *_ in rows:
        per[s] += size(t)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(["a", "b", "c", "é", None])}
    target, left, rest = {}, set(per), sum(per.values())
    while left:
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 3 * per[s]}
        for s in over or left:
            target[s] = 3 * per[s] if over else share[s]
        rest -= sum(target[s] for s in over)
        left = left - over if over else set()
    source = {(d): s for d, _, _, s, *_ in rows}
    taken = collections.Counter()
    for r in out:
        s = source[r.doc_id]
        taken[s] += r.taken
        assert r.target == pytest.approx(target[s]) and r.source_size == per[s] and r.taken <= 3 * r.size
    assert len(out) == len(rows) and all(abs(taken[s] - target[s]) <= mixing.BLOCK_WORDS * 1.5 for s in per)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(size(r.text) for r in mixed.collect()) == sum(taken.values())
    assert mixing.taken_words(empty).count() == 0 and mixing.mix_documents(empty).count() == 0


def test_small_sources_get_their_targets(spark):
    rows = [(i * 4 + j, "w " * (25 + (j % 2) * 2 * (i % 5)), f"s{i:03d}") for i in range(60) for j in range(4)]
    rows += [(10_000 + j, "long text " * 300, "z") for j in range(7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    source, size = {r[0]: r[2] for r in rows}, {r[0]: len(r[1].split()) for r in rows}
    taken, target = collections.Counter(), {}
    for r in mixing.taken_words(df).collect():
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        assert r.taken <= 3 * r.size
    assert len(target) == 61 and all(abs(taken[s] - t) <= 0.5 for s, t in target.items())
    mixed = collections.Counter()
    for r in mixing.mix_documents(df).collect():
        mixed[r.source] += len(r.text.split())
        assert len(r.text.split()) <= size[r.doc_id]
    assert mixed == taken


def test_mixed_blocks_fill_shards(spark):
    rows = [(i, " ".join(f"{s}{i}.{j}" for j in range(n)), s) for s, i, n in
            [("a", i, 40 + i) for i in range(9)] + [("b", 100 + i, 7) for i in range(5)] + [(None, 200, 500), ("c", 300, 0)]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    blocks = mixing.mix_blocks(df, words=16).collect()
    used, sizes = collections.Counter(), collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    for b in blocks:
        words = b.text.split()
        assert len(words) == b.n_words <= 16 and 0 <= b.shard < 64
        assert all(w.startswith(b.source or "None") for w in words)
        used.update(words)
    assert max(used.values()) <= 3
    # Every slot of a shard and source is there once, numbered from 0, and each epoch takes a block once.
    by_shard = collections.defaultdict(list)
    for b in blocks:
        by_shard[b.shard, b.source].append(b.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values()) and len({k[0] for k in by_shard}) > 20
    assert len({(b.source, b.epoch, b.block) for b in blocks}) == len(blocks)
    # The documents' figures are those of the blocks.
    home = {w: d for d, t, _ in rows for w in t.split()}
    taken, shards = collections.Counter(), collections.defaultdict(set)
    for b in blocks:
        for w in b.text.split():
            taken[home[w]] += 1
            shards[home[w]].add(b.shard)
    got = {r.doc_id: (r.taken, r.n_shards) for r in mixing.taken_words(df, words=16).collect()}
    assert got == {d: (taken[d], len(shards[d])) for d, _, _ in rows}
    assert mixing.mix_blocks(df.limit(0)).count() == 0


def test_slots_of_shards_are_multinomial(spark):
    totals = spark.createDataFrame([(0, 64_000), (1, 640), (2, 0)], "sid long, slots long")
    rows = mixing.shard_counts(totals, 64).collect()
    count = collections.Counter()
    for r in rows:
        count[r.sid] += r.slots
    assert count == {0: 64_000, 1: 640}
    for sid, slots in ((0, 64_000), (1, 640)):
        seen = {r.shard: r.slots for r in rows if r.sid == sid}
        each = slots / 64
        chi = sum((seen.get(i, 0) - each) ** 2 / each for i in range(64))
        assert 25 < chi < 125  # 63 degrees of freedom: neither uneven nor dealt in turn


def test_targets_stop_at_three_times_the_size(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 0), (None, 90)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert got["a"] == 30.0 and got["c"] == 0.0 and sum(got.values()) == pytest.approx(1100)
    assert got[None] == 270.0 and got["b"] == pytest.approx(800)


def test_optimal_bounds_against_all_choices():
    from itertools import combinations

    lengths, counts = np.array([1, 3, 4, 9, 10, 30]), np.array([5, 1, 7, 2, 2, 1])
    for buckets in (1, 2, 3, 6):
        best = min(
            sum(c * next(b for b in (*cut, 30) if b >= n) for n, c in zip(lengths, counts))
            for cut in combinations(lengths[:-1].tolist(), buckets - 1)
        )
        assert packing.optimal_bounds(lengths, counts, buckets)[1] == best


def test_packing(docs, rows, empty):
    out = packing.pack(docs, buckets=4, budget=100).collect()
    batches = collections.defaultdict(list)
    for r in out:
        assert r.length <= r.padded_length
        batches[r.bucket, r.shard, r.batch].append(r)
    assert len(out) == len(rows)
    for b in batches.values():
        assert sorted(r.slot for r in b) == list(range(len(b))) and (len(b) == 1 or b[0].batch_tokens <= 100)
    assert packing.pack(empty).count() == 0


def test_exact_groups(docs, rows, empty):
    norm = {i: re.sub(r"[\x20\x09-\x0D]", "", r[1] or "") for i, r in enumerate(rows)}
    groups = collections.defaultdict(list)
    for i, r in enumerate(rows):
        groups[norm[i]].append((-len(r[1] or ""), r[0]))
    want = collections.Counter((r[0], min(groups[norm[i]])[1], len(groups[norm[i]])) for i, r in enumerate(rows))
    got = perfect_hash.exact_groups(docs).collect()
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == want
    assert perfect_hash.keep_one(docs).count() == len(groups) and perfect_hash.exact_groups(empty).count() == 0


def test_minimal_perfect_hash():
    digests = np.random.default_rng(2).integers(0, 256, (3000, 32), dtype=np.uint8)
    strides, shifts, slots = perfect_hash.build_hash(digests)
    assert sorted(slots) == list(range(3000))
    assert (perfect_hash.find_slots(digests, 3000, strides, shifts) == slots).all()


def test_minimal_perfect_hash_of_any_size():
    rng = np.random.default_rng(6)
    for n in [*range(1, 65), 128, 256, 1024, 2048, 4096]:
        for _ in range(6 if n <= 64 else 1):
            digests = rng.integers(0, 256, (n, 32), dtype=np.uint8)
            strides, shifts, slots = perfect_hash.build_hash(digests)
            assert sorted(slots) == list(range(n))
            assert (perfect_hash.find_slots(digests, n, strides, shifts) == slots).all()


def test_minimal_perfect_hash_of_equal_low_bits(monkeypatch):
    digests = np.zeros((2, 32), np.uint8)
    digests[1, 0] = 1  # only the first bytes differ: no displacement parts the two, the salt does
    monkeypatch.setattr(perfect_hash, "STRIDES", 8)
    strides, shifts, slots = perfect_hash.build_hash(digests)
    assert sorted(slots) == [0, 1] and strides[0] > 0
    assert (perfect_hash.find_slots(digests, 2, strides, shifts) == slots).all()


def test_exact_groups_of_copies_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(perfect_hash, "BUCKET_KEYS", 32)
    rows = [(i, f"text {i % 150}") for i in range(1200)]
    got = perfect_hash.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = collections.Counter((i, i % 150, 8) for i, _ in rows)
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == want


def test_lattice_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 16))
    near = base[:30] + rng.standard_normal((30, 16)) * 0.05
    vectors = np.concatenate([base, near, base[:5], np.tile(base[7], (40, 1)) + rng.standard_normal((40, 16)) * 0.01])
    table = [(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(vectors)]
    n = len(table)
    odd = [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] * 16, 0), (n + 3, [], 0), (n + 4, [None] * 16, 0)]
    df = spark.createDataFrame(table + odd, "vec_id long, embedding array<float>, label int")
    x = np.array([t[1] for t in table], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    link = (x @ x.T >= 0.95) & ~np.eye(n, dtype=bool)
    root = components(n, list(zip(*np.nonzero(link))))
    want = {i: (int(link[i].sum()), root[i]) for i in range(n)} | {r[0]: (0, r[0]) for r in odd}
    for block in (1500, 9):
        got = {r.vec_id: (r.n_links, r.component_id) for r in lattice.near_duplicates(df, block=block).collect()}
        assert sum(got[i] != want[i] for i in want) == 0
    assert lattice.near_duplicates(df.limit(0)).count() == 0


def test_lattice_points_are_the_nearest():
    x = np.random.default_rng(5).uniform(-2, 2, (200, 8))
    points, far = lattice.e8_points(x, 2)
    doubled = (2 * points[:, 0]).astype(int)
    assert ((doubled % 2).sum(axis=1) % 8 == 0).all() and (points[:, 0].sum(axis=1) % 2 == 0).all()
    assert (far[:, 0] <= 1 + 1e-9).all() and (far[:, 0] <= far[:, 1]).all()


def test_licences(spark, empty):
    whole = licences.KNOWN["MIT"][2]
    rows = [(1, "Copyright (c) 2020 A\n" + whole.upper()), (2, "text\nReleased under the MIT licence!\nmore"),
            (3, None), (4, ""), (5, "licence")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan_licences(df, licences.known_licences(spark)).collect()}
    assert got[1].licence == "MIT" and got[2].licence is None and got[2].notices == ["MIT"]
    assert [got[i].notices for i in (3, 4, 5)] == [[], [], []]
    assert licences.scan_licences(empty, licences.known_licences(spark)).count() == 0


def test_whole_licences_and_lines_that_go_on(spark):
    mit = licences.KNOWN["MIT"][2]
    ids = ["Apache-2.0", "MPL-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0"]
    rows = [(i, (licences.TEXTS / f"{n}.txt").read_text()) for i, n in enumerate(ids)]
    rows += [(20, f"Copyright (c) 2020 A. {mit}"), (21, "Copyright 2020 A. Released under the MIT License."),
             (22, "Copyright (c) 2020, B Inc. All rights reserved."), (23, f"MIT License\n\nCopyright (c) 2021 C\n\n{mit}"),
             (24, "BSD 3-Clause License\n\nCopyright (c) 2021, D\nAll rights reserved.\n\n" + rows[7][1])]
    numbers = iter("12")
    rows += [(25, re.sub(r"(?m)^ +\*", lambda _: f"{next(numbers)}.", rows[6][1]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan_licences(df, licences.known_licences(spark)).collect()}
    assert [got[i].licence for i in range(len(ids))] == ids and got[25].licence == "BSD-2-Clause"
    assert [got[i].licence for i in (20, 21, 22, 23, 24)] == ["MIT", "MIT", None, "MIT", "BSD-3-Clause"]
    assert got[21].notices == ["MIT"] and got[22].notices == []


@pytest.mark.parametrize("words, percent, block", [(3, 90, 1000), (5, 80, 3), (1, 50, 1000)])
def test_similar_groups(docs, rows, words, percent, block):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(low))
        grams = {tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
        sets.append(grams)
    links = [
        (i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i])
        if a and b and 100 * len(a & b) >= percent * len(a | b)
    ]
    root = components(len(rows), links)
    least = [min(rows[j][0] for j in range(len(rows)) if root[j] == root[i]) for i in range(len(rows))]
    got = prefix_tree.similar_groups(docs, words, percent, block).collect()
    want = collections.Counter((r[0], len(sets[i]), least[i]) for i, r in enumerate(rows))
    assert collections.Counter(map(tuple, got)) == want


def test_similar_groups_of_nothing(empty):
    assert prefix_tree.similar_groups(empty).count() == 0


def test_quality(spark, docs, empty):
    good = ["The quiet river runs past the old mill and the village green. " * k for k in range(1, 60)]
    bad = ["BUY!!! NOW$$$ CHEAP%%% CLICK### HERE!!! " * k for k in range(1, 60)]
    rows = [(i, t) for i, t in enumerate(good + bad)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(
        [(i, int(i < 59), 0) for i in range(118)] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int"
    )
    model = quality.fit(table, labels)
    out = {r.doc_id: r.score for r in quality.score_texts(table, model).collect()}
    assert all((out[i] >= 0.5) == (i < 59) for i in range(118))
    for r in quality.score_texts(docs.where("text is null or text = ''"), model).collect():
        assert r.score == pytest.approx(1 / (1 + np.exp(-model.bias)), rel=1e-5)
    assert quality.score_texts(empty, quality.fit(empty, labels.limit(0))).count() == 0
    kept = quality.keep_good(table, model)
    assert kept.columns == table.columns and kept.count() == 59
