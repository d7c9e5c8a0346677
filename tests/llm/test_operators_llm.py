"""The training-data operators against brute force, on small tables with nulls, blanks, long texts, ties and copies."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rollcall.llm import bpe, components, embedding_dedup, exact_dedup, language_id, licenses, mixing, prefix, quality, sharding, simhash, substring_dedup, trie
from rollcall.llm.queries import vocabulary_path
from rollcall.llm.storage import numbered

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard_note string"
RNG = random.Random(5)
WORDS = ["".join(RNG.choices("aeinorst", k=RNG.randint(2, 7))) for _ in range(300)]


def prose(n, seed):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def rows():
    texts = [prose(n, n) for n in (3, 40, 90, 200)]
    texts += [texts[2], texts[2].replace(" ", "\n\t"), texts[3] + " tail", None, "", "  ", "\n", "x" * 5000, texts[1] + " " + texts[1], "Ünïcödé Ärger öde", "Σίσυφος ΣΑΣ 12½"]
    texts += [texts[2]] * 20 + [prose(70, i) for i in range(30)]
    out = [(i if i != 6 else None, t, ("en", "de", None)[i % 3], ("a", "b", None)[i % 3], len(t or ""), "n") for i, t in enumerate(texts)]
    return out + [out[0], out[0], (3, "another text for three", None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("llm") / "docs")
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df):
    return [r.asDict() for r in df.collect()]


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


# Sharding


def sharded(df, n):
    raw = F.coalesce("text", F.lit("")).cast("binary")
    return sharding.shard_by_size(df.withColumns({"size": F.octet_length(raw).cast("long") + 8, "h": F.xxhash64("text")}), n, "size", "h", "doc_id")


def test_shards_take_all_rows_with_gapless_slots_and_near_equal_sizes(docs, monkeypatch):
    monkeypatch.setattr(prefix, "FEW_ROWS", 2)
    got = collected(sharded(docs, 4))
    assert len(got) == len(rows())
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert all(sorted(x["slot"] for x in v) == list(range(len(v))) for v in by.values())
    sizes = [sum(x["size"] for x in v) for v in by.values()]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in got)


def test_a_third_of_all_rows_with_one_text_is_cut_inside(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    sizes = sharded(df, 6).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    assert len(sizes) == 6 and max(r.s for r in sizes) < 1.2 * min(r.s for r in sizes)


def test_shards_of_nothing(nothing):
    assert sharded(nothing, 4).count() == 0


def test_equal_rows_without_identifiers_are_cut_apart(spark, monkeypatch):
    monkeypatch.setattr(prefix, "FEW_ROWS", 2)
    df = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    got = collected(sharded(df, 8))
    assert Counter(r["shard"] for r in got) == Counter({s: 500 for s in range(8)}) or max(Counter(r["shard"] for r in got).values()) <= 1.1 * 500
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert len(by) == 8 and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_running_totals_are_exact(spark):
    df = spark.range(500).select((F.col("id") % 7).alias("k"), F.col("id").alias("doc_id"), (F.col("id") % 11).alias("w"))
    bounds = prefix.boundaries_of(df, ["k", "doc_id"], "w", "doc_id", 2485, 16)
    got = sorted(collected(prefix.running(df, ["k", "doc_id"], ["w"], bounds)), key=lambda r: (r["k"], r["doc_id"]))
    assert [r["_n"] for r in got] == list(range(500))
    assert [r["w_before"] for r in got] == [0, *itertools.accumulate(r["w"] for r in got[:-1])]


# Exact dedup


@pytest.mark.parametrize("budget", [exact_dedup.TRIE_BYTES, 600])
def test_exact_groups(docs, budget):
    want = defaultdict(list)
    for r in rows():
        want[normal(r[1])].append(r[0])
    got = collected(exact_dedup.exact_groups(numbered(docs), budget=budget))
    assert len(got) == len(rows())
    seen = Counter()
    for r in got:
        (text,) = [t for t in want if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"]]
        assert r["keep_id"] == min((i for i in want[text] if i is not None), default=None)
        assert r["group_size"] == len(want[text])
        seen[text] += r["kept"]
    assert set(seen.values()) == {1}


def test_first_copies_keep_the_columns(docs, nothing):
    got = exact_dedup.keep_first_copies(docs)
    assert got.columns == docs.columns
    assert Counter(normal(r["text"]) for r in collected(got)) == Counter({normal(r[1]) for r in rows()})
    assert exact_dedup.keep_first_copies(nothing).count() == 0


def test_trie_forks_and_detaches():
    tree, keys = trie.Patricia(), [b"", b"ab", b"abc", b"abd", b"b", b"abcdef"]
    for i, k in enumerate(keys):
        tree.at(k).value = i
    assert sorted(tree.entries()) == sorted(zip(keys, range(6), strict=True))
    path, out = tree.detach_largest()
    assert path == b"a" and len(out) == 4 and len(list(tree.entries())) == 2


# Mixing


def test_targets_stop_at_twice_the_source():
    got = mixing.targets({"a": 10, "b": 1000, "c": 100, None: 50})
    assert got["a"] == 20 and got["b"] < 2000 and sum(got.values()) == pytest.approx(1.5 * 1160)


def test_mix_meets_its_targets(spark, docs, nothing):
    sized = docs.withColumn("size", mixing.word_count(F.col("text")))
    got = collected(mixing.mix(sized, "source", "size", "doc_id"))
    assert len(got) == len(rows())
    for source in ("a", "b", None):
        own = [r for r in got if r["source"] == source]
        assert own[0]["source_size"] == sum(len((r[1] or "").split()) for r in rows() if r[3] == source)
        assert abs(sum(r["copies"] * r["size"] for r in own) - own[0]["target"]) <= 2 * max(r["size"] for r in own)
    assert {r["copies"] for r in got} <= {0, 1, 2}
    assert got == collected(mixing.mix(sized, "source", "size", "doc_id")) or sorted(map(str, got)) == sorted(map(str, collected(mixing.mix(sized, "source", "size", "doc_id"))))
    assert mixing.mix(nothing.withColumn("size", F.lit(1).cast("long")), "source", "size", "doc_id").count() == 0
    assert mixing.take_mix(docs).columns == docs.columns


# BPE


@pytest.fixture(scope="module")
def reference_tokenizer():
    found = pytest.importorskip("tokenizers").Tokenizer.from_file(vocabulary_path())
    found.no_truncation()
    found.no_padding()
    return found


def test_bpe_equals_the_tokenizers_library(reference_tokenizer):
    rng = random.Random(2)
    pools = [range(32, 127), range(0, 0x250), range(0x370, 0x52F), range(0x3041, 0x3097), range(0x4E00, 0x9FA0)]
    texts = ["".join(chr(rng.choice(rng.choice(pools))) for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += ["<|endoftext|>a<|startoftext|", "we'll don't I'S", "a" * 3000, "ΑΣ σΣ", "", " ", "\x1c\x85 a", prose(500, 1)]
    got = bpe.WordBpe(vocabulary_path()).encode([*texts, None])
    assert got[-1] == (b"", "")
    for text, (ids, shown) in zip(texts, got, strict=False):
        want = reference_tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert shown == reference_tokenizer.decode(want, skip_special_tokens=False)


def test_bpe_reads_every_letter_as_the_library_does(reference_tokenizer):
    """Code points that Unicode versions class differently among them, and long mixed text."""
    codes = [*range(0x250, 0x3400), *range(0xA640, 0xAC00, 3), *range(0xFB00, 0x11000), *range(0x11000, 0x20000, 5), *range(0x30000, 0x32000, 61)]
    codes = [c for c in [*codes, 0x558, 0x58B, 0x208F, 0xA7CB, 0x130, 0x1E9E] if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{chr(c)}b{chr(c)} 1{chr(c).upper()}" for c in codes[at : at + 200]) for at in range(0, len(codes), 200)]
    rng, pool = random.Random(5), "\u0020\n\u3042\u0301\u00e9A\u0130\U0001f600\u0085\u00a0\u2028\u3000\u110b\u1161\u11a8"
    texts += ["".join(rng.choices(pool, k=50_000)), "\u0430\u0431" * 500 + " \u0430"]
    for text, (ids, shown) in zip(texts, bpe.WordBpe(vocabulary_path()).encode(texts), strict=True):
        want = reference_tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert shown == reference_tokenizer.decode(want, skip_special_tokens=False)


def test_bpe_over_a_table(docs, nothing, reference_tokenizer):
    got = bpe.decode_tokens(bpe.encode_tokens(docs, vocabulary_path()).withColumnRenamed("decoded", "shown"), vocabulary_path())
    assert all(r["decoded"] == r["shown"] and len(r["tokens"]) == len(reference_tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) for r in collected(got))
    assert bpe.encode_digests(nothing, vocabulary_path()).count() == 0
    clashing = bpe.encode_tokens(docs.withColumn("tokens", F.lit(1)), vocabulary_path())
    assert clashing.columns == [*docs.columns, "tokens_input", "tokens", "decoded"]


# Components, SimHash


def brute_components(n, pairs):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_components_of_a_path_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(200, 200), (None, 3)]
    got = {r["node"]: r["root"] for r in collected(components.components(spark.createDataFrame(edges, "a long, b long")))}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 120)}


def brute_fingerprint(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + width]).encode(), 42) for i in range(max(1, len(words) - width + 1))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_groups(docs, nothing):
    got = sorted(collected(simhash.near_groups(numbered(docs))), key=lambda r: r["_row"])
    texts = {r["_row"]: r["text"] for r in collected(numbered(docs))}
    prints = [brute_fingerprint(texts[r["_row"]], 4) for r in got]
    assert [r["fp"] % (1 << 64) for r in got] == prints
    roots = brute_components(len(prints), [(i, j) for i, j in itertools.combinations(range(len(prints)), 2) if (prints[i] ^ prints[j]).bit_count() <= 4])
    least = defaultdict(list)
    for r, root in zip(got, roots, strict=True):
        least[root].append(r["doc_id"])
    assert [r["component_id"] for r in got] == [min((i for i in least[root] if i is not None), default=None) for root in roots]
    kept = simhash.keep_first_of_groups(docs)
    assert kept.columns == docs.columns and kept.count() == len(least)
    assert simhash.near_groups(numbered(nothing)).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 6])
def test_no_link_is_missed(spark, monkeypatch, radius):
    monkeypatch.setattr(simhash, "BLOCK", 40)
    rng = random.Random(radius)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for x in list(prints)[:40]:
        for _ in range(3):
            x ^= sum({1 << b for b in rng.choices(range(64), k=rng.randint(1, 7))})
            prints.add(x & (1 << 64) - 1)
    prints = sorted(prints)
    frame = spark.createDataFrame([(simhash._signed(x),) for x in prints], "fp long")
    links = [(prints.index(r["a"] % (1 << 64)), prints.index(r["b"] % (1 << 64))) for r in collected(simhash.fingerprint_links(frame, len(prints), radius))]
    near = [(i, j) for i, j in itertools.combinations(range(len(prints)), 2) if (prints[i] ^ prints[j]).bit_count() <= radius]
    assert brute_components(len(prints), links) == brute_components(len(prints), near)


# Embeddings


def test_embeddings_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 20)
    rng = np.random.default_rng(1)
    base = rng.standard_normal((30, 16))
    data = [*base.tolist(), *(base[:20] * 3 + rng.normal(0, 0.3, (20, 16))).tolist(), *([base[0].tolist()] * 40), *(base[1] + rng.normal(0, 0.05, (60, 16))).tolist()]
    data += [None, [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] * 16, [], [1e300] * 16, [1e-300] * 16]
    frame = spark.createDataFrame(list(enumerate(data)), "vec_id long, embedding array<double>").withColumn("label", F.lit(1))
    ok = [i for i, v in enumerate(data) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(data[i]) / np.abs(data[i]).max() for i in ok}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    pairs = [(a, b) for a, b in itertools.combinations(ok, 2) if unit[a] @ unit[b] >= 0.9]
    roots, degree = brute_components(len(data), pairs), Counter(itertools.chain(*pairs))
    got = {r["vec_id"]: r for r in collected(embedding_dedup.near_vectors(frame))}
    assert len(got) == len(data)
    found = sum(r["n_links"] for r in got.values())
    assert 0.99 * 2 * len(pairs) <= found <= 2 * len(pairs)
    assert all(r["n_links"] <= degree[i] for i, r in got.items())
    assert sum(got[i]["component_id"] != roots[i] for i in got) <= 1
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())
    assert embedding_dedup.near_vectors(frame.limit(0)).count() == 0


def test_single_precision_vectors_as_their_doubles(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 8)).astype(np.float32)
    near = (base + rng.normal(0, 0.1, base.shape)).astype(np.float32)
    data = [*base.tolist(), *near.tolist(), base[3].tolist(), [-0.0, *base[4][1:].tolist()], [0.0, *base[4][1:].tolist()], None, [0.0] * 8, [float("nan")] * 8]
    frames = [spark.createDataFrame(list(enumerate(data)), f"vec_id long, embedding array<{kind}>") for kind in ("float", "double")]
    single, double = (sorted(map(tuple, embedding_dedup.near_vectors(f).collect()), key=str) for f in frames)
    assert single == double
    assert {r[0]: r[1] for r in single}[82] >= 1


# Languages


def test_codewords_differ():
    for n in (2, 3, 4, 5, 9, 20):
        code = language_id.codebook(n)
        assert len({tuple(r) for r in code.tolist()}) == n and all(len(set(c)) == 2 for c in code.T.tolist())


def test_languages_are_learned_and_blank_texts_are_not(spark, nothing):
    kinds = {"xx": "abcde", "yy": "mnopq", "zz": "vwxyz"}
    rng = random.Random(3)
    data = [(i, " ".join("".join(rng.choices(kinds[k], k=4)) for _ in range(20)), k) for i, k in enumerate(list(kinds) * 20)]
    frame = spark.createDataFrame([*data, (90, None, "xx"), (91, "12 !", "xx"), (92, "abcd" * 40000, None), (92, "", None)], "doc_id long, text string, lang string")
    model = language_id.fit(frame.where(~language_id.held_out("doc_id")))
    got = {(r["doc_id"], r["lang"]): r for r in collected(language_id.identify(frame, model))}
    assert all(got[i, k]["lang_pred"] == k for i, _, k in data)
    assert got[90, "xx"]["lang_pred"] == got[91, "xx"]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    empty = language_id.fit(nothing)
    assert {r["lang_pred"] for r in collected(language_id.identify(frame, empty))} == {"und"}
    assert language_id.identify(nothing, model).count() == 0


def test_counts_do_not_depend_on_parts(monkeypatch):
    text = prose(400, 9)
    where, count = language_id.ngram_counts(text)
    monkeypatch.setattr(language_id, "CHUNK", 100)
    again, more = language_id.ngram_counts(text)
    assert where.tolist() == again.tolist() and count.tolist() == more.tolist()


# Licences


def test_license_scan(spark, nothing):
    mit = licenses.KNOWN_TEXTS["MIT"]
    texts = ["Copyright (c) 2020 A. Person\n\n" + mit.upper().replace(",", " ;").replace("SUBLICENSE", "sub-licence"), "some text\nRELEASED under the  MIT Licence!\r\nmore", mit + " and more", None, "", "© 2020 nobody", "Licensed under CC BY-NC 4.0.\nReleased under the MIT License."]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("entire", F.lit(1))
    got = {r["doc_id"]: (r["license"], r["notices"]) for r in collected(licenses.scan(frame))}
    assert got == {0: ("MIT", []), 1: (None, ["MIT"]), 2: (None, []), 3: (None, []), 4: (None, []), 5: (None, []), 6: (None, ["CC-BY-NC-4.0", "MIT"])}
    assert licenses.scan(nothing).count() == 0
    plan = licenses.scan(frame)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# Substrings


def brute_removed(texts, length):
    starts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if starts[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("length,gram", [(400, 64), (40, 8)])
def test_repeated_strings_against_brute_force(spark, docs, nothing, length, gram, monkeypatch):
    monkeypatch.setattr(substring_dedup, "PART", 700)
    passage, rng = prose(80, 77), random.Random(4)
    extra = [prose(rng.randint(5, 90), 1000 + i) + passage[rng.randint(0, 60) : rng.randint(300, 480)] + prose(5, 2000 + i) for i in range(25)]
    extra += ["ab" * 600, "z" * 900, "é" * 450 + passage, passage + passage]
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    texts = [r["text"] for r in collected(frame)]
    want = Counter()
    for t, gone in zip([(t or "").encode() for t in texts], brute_removed([(t or "").encode() for t in texts], length), strict=True):
        runs = int((np.diff(np.concatenate(([0], gone.astype(int), [0]))) == 1).sum())
        want[len(t), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()] += 1
    got = substring_dedup.removal_digests(frame, length=length, gram=gram)
    assert Counter((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in collected(got)) == want
    assert substring_dedup.removal_digests(nothing).count() == 0


def test_kept_bytes_carry_the_columns(docs):
    got = collected(substring_dedup.without_repeats(docs))
    assert len(got) == len(rows())
    assert all(hashlib.sha256(r["kept_bytes"]).hexdigest() == r["kept_sha256"] for r in got)
    assert all(len(r["kept_bytes"]) == r["n_bytes"] - sum(s["stop"] - s["begin"] for s in r["spans"]) for r in got)


# Quality


def test_labellers_and_scorer_tell_junk_from_prose(spark, nothing):
    junk = [" ".join(w + "###" for w in prose(60, i).split()) for i in range(40)] + [prose(3, i).upper() + "!! " * 40 for i in range(40)] + [(prose(1, i) + " ") * 60 for i in range(40)]
    good = [prose(80, 300 + i).capitalize() + "." for i in range(300)]
    data = [(i, t, int(i >= len(junk))) for i, t in enumerate(junk + good)]
    frame = spark.createDataFrame([*data, (900, None, 0), (901, " ", 0), (902, "Short.", 1), (None, good[0], 1), (None, good[0], 1)], "doc_id long, text string, want int")
    got = collected(quality.scored(frame, quality.fit(frame)))
    assert sum(r["keep"] == bool(r["want"]) for r in got) >= 0.98 * len(got)
    assert all(r["keep"] for r in got if r["want"])
    assert quality.keep_good(frame).columns == frame.columns
    assert quality.keep_good(nothing).count() == 0
