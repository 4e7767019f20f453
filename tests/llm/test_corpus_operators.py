"""Fingerprints, near copies, packing, token counts, token files, preference pairs and the pipeline."""

import zlib

import numpy as np
import pytest
import xxhash
from helpers import frame, lower, nasty, structured, words
from pyspark.sql import functions as F

from shopfloor.llm import packing, preferences, simhash, token_counts, token_store

public_tokenizers = pytest.importorskip("public_tokenizers")


def fingerprint(t):
    w = words(lower(t))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(n, near):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            if near(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def test_simhash_components(spark):
    docs = [d for d in nasty(7) if len(d[1] or "") < 20000]
    fps = [fingerprint(t) for _, t in docs]
    groups = linked(len(docs), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    least = {}
    for (i, _), g in zip(docs, groups):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    want = sorted((str(i), f, str(least.get(g))) for (i, _), f, g in zip(docs, fps, groups))
    out = simhash.components(frame(spark, docs)).collect()
    assert sorted((str(r["doc_id"]), r["fp"] & (1 << 64) - 1, str(r["component_id"])) for r in out) == want
    assert simhash.components(frame(spark, docs).limit(0)).count() == 0


def test_near_duplicates(spark):
    docs = nasty(8)
    d = frame(spark, docs)
    out = simhash.near_duplicates(d)
    assert out.columns == d.columns
    named = [(i, t) for i, t in docs if i is not None]
    sets = []
    for _, t in named:
        w = words(lower(t))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    groups = linked(len(named), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    least = {}
    for (i, _), g in zip(named, groups):
        least[g] = min(least.get(g, i), i)
    got = sorted(r["doc_id"] for r in out.collect() if r["doc_id"] is not None)
    assert got == sorted(set(least.values()))
    assert out.where("doc_id is null").count() == sum(i is None for i, _ in docs)
    assert simhash.near_duplicates(d.limit(0)).count() == 0


def test_packing_keeps_all_and_conflicts_apart(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = nasty(9) + [((1 << 60) + 1, "a b"), ((1 << 60) + 2, "c d e")] + [(950, "the same row")] * 90
    d = packing.with_sizes(frame(spark, docs), path).cache()
    rows = packing.pack(d, capacity=256, group=40).collect()
    sizes, want, seen = {}, {}, {}
    for r in d.collect():
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["n_tokens"]
        seen.setdefault(r["doc_id"], set()).add((r["source"], r["cluster"]))
    for i, t in docs:
        want[i] = want.get(i, 0) + len(model.encode(t or "")) + 1
    assert sizes == want
    got, bins = {}, {}
    for r in rows:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
        bins.setdefault(r["bin_id"], []).append((r["bin_offset"], r["length"], r["doc_id"], r["part"]))
    assert got == sizes
    for pieces in bins.values():
        pieces.sort(key=lambda p: p[:2])
        assert pieces[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(pieces, pieces[1:])) and pieces[-1][0] + pieces[-1][1] <= 256
        known = [next(iter(seen[i])) for _, _, i, _ in pieces if i is not None and len(seen[i]) == 1]
        for k in (0, 1):
            own = [x[k] for x in known if x[k] is not None]
            assert len(own) == len(set(own))
    assert len({r["bin_id"] for r in rows if r["doc_id"] == 950}) == 90
    clusters = {i: {c for _, c in seen[i]} for i in seen}
    assert clusters[5] == clusters[6] and clusters[1] == clusters[2] == clusters[3] and clusters[4] != clusters[5]
    assert packing.pack(d.limit(0)).count() == 0
    assert packing.with_sizes(frame(spark, docs).limit(0), path).count() == 0


def test_token_counts(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = nasty(10) + [(900, "  a  b "), (901, "a\n\nb\n c"), (902, "<s> </s>"), (903, "\n"), (904, "a▁b ▁▁"), (905, "x\ty \r\n z　 ​"), (906, " \n"), (2**63 - 1, "last id"), *structured()]
    got = sorted((tuple(r) for r in token_counts.token_counts(frame(spark, docs), path).collect()), key=str)
    assert got == sorted(((i, len((t or "").encode()), len(model.encode(t or ""))) for i, t in docs), key=str)
    assert token_counts.token_counts(frame(spark, docs).limit(0), path).count() == 0


def test_token_files(spark):
    import tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    docs = nasty(11) + [(900, "don't 've"), (901, "a<|endoftext|>b"), (902, "a \n b\n\nc  "), (903, "tab\t\tx \ty\x0b"), (904, "ŁÓDŹ ʀ\x7f"), *structured()]
    d = frame(spark, docs)
    dictionary = token_store.train_dictionary(d, path, 2)
    files = token_store.write_files(d, path, 2, dictionary)
    order = sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode()))
    want, at = [], 0
    for i, t in order:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in token_store.read_files(files, dictionary).orderBy("start").collect()] == want
    one = token_store.TokenFile(bytes(files.first()["content"]), dictionary)
    assert one.ids(0).dtype.itemsize == 2 and one.ids(one.n - 1)[-1] == 2
    with pytest.raises(ValueError):
        token_store.TokenFile(bytes(files.first()["content"]), b"another dictionary")
    assert token_store.read_files(token_store.write_files(d.limit(0), path, 2, dictionary), dictionary).count() == 0


def test_preference_pairs(spark):
    kind = "pair_id long, turn long, role string, text string, prompt string"
    chosen = [(1, 0, "user", "hi", "x"), (1, 1, "assistant", "yes", "x"), (2, 0, "user", None, "x"), (3, 0, None, "a", "x"), (None, 0, "user", "a", "x"), (5, 0, "user", "same", "x")]
    rejected = [(1, 1, "assistant", "no", "x"), (1, 0, "user", "hi", "x"), (2, 0, "user", "", "x"), (2, 1, "assistant", "é", "x"), (5, 0, "user", "same", "x"), (6, 0, "user", "b", "x")]
    got = {r["pair_id"]: r for r in preferences.format_pairs(spark.createDataFrame(chosen, kind), spark.createDataFrame(rejected, kind)).collect()}
    assert set(got) == {1, 2, 3, 5, 6} and {k for k, r in got.items() if r["paired"]} == {1, 2, 5}
    assert (got[1]["n_common"], got[1]["prompt"], got[1]["chosen"], got[1]["rejected"]) == (1, "<|user|>\nhi\n", "<|assistant|>\nyes\n", "<|assistant|>\nno\n")
    assert got[1]["chosen"][int(got[1]["chosen_trained"].split(":")[0]) :] == "yes\n"
    assert (got[2]["n_common"], got[2]["chosen"], got[2]["rejected_trained"]) == (1, "", "14:16")
    assert (got[3]["chosen"], got[3]["chosen_trained"], got[3]["rejected"]) == ("<|unknown|>\na\n", "", "")
    assert (got[5]["n_common"], got[5]["chosen"], got[5]["rejected"]) == (1, "", "")
    empty = spark.createDataFrame([], kind)
    assert preferences.format_pairs(empty, empty).count() == 0
    turns = spark.createDataFrame([(2, 0, "user", "q"), (2, 1, "assistant", "a"), (3, 0, "user", "q2"), (3, 1, "assistant", "b"), (4, 0, "assistant", "c"), (6, 0, "user", "no reply"), (None, 0, "user", "z")], "conv_id long, turn long, role string, text string")
    pairs = {r["pair_id"]: r for r in preferences.format_pairs(*preferences.with_swapped_reply(turns)).collect()}
    assert set(pairs) == {2, 3, 4} and pairs[2]["rejected"] == "<|assistant|>\nb\n" and pairs[4]["rejected"] == ""


def test_pipeline(spark, sf_dir):
    """Each stage's rows and texts against a plain version on the stage's own input."""
    import plain_secrets
    from test_near_copies import kept as least_of_groups
    from test_text_operators import plain_counts, plain_matches

    from shopfloor.llm import quality

    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    rules = quality.learn(quality.training_rows(docs, labels))
    stats = {r["doc_id"]: r.asDict() for r in quality.with_statistics(docs).selectExpr("doc_id", *[f"{v} as {k}" for k, v in quality.FEATURES.items()]).collect()}

    def by_rules(rows):
        out = {}
        for i, t in rows.items():
            n, _, _, _, twice = plain_counts(t)
            if n >= 50 and 100 * twice <= 50 * n and not any(r.holds(stats[i]) for r in rules):
                out[i] = t
        return out

    def by_copies(rows):
        own = sorted(rows.items())
        return {i: rows[i] for i in least_of_groups([(i, t or "") for i, t in own])}

    def by_benchmark(rows):
        long = [(k, u) for k, u in items if len(words(u)) >= 5]
        near = [(i, t) for i, t in rows.items() if any(len(set(words(lower(t))) & set(words(lower(u)))) >= 3 for _, u in long)]
        dirty = {m[0] for m in plain_matches(near, long)}
        return {i: t for i, t in rows.items() if i not in dirty}

    kept = docs
    for name, stage in pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in kept.select("doc_id", "text").collect()}
        spans = plain_secrets.spans(sorted(before.items())) if name == "secret_scan" else {}
        kept = pipeline.materialize(stage(spark, kept, sf_dir))
        assert tuple(kept.columns) == pipeline.COLUMNS, name
        after = {r["doc_id"]: r["text"] for r in kept.select("doc_id", "text").collect()}
        assert kept.count() == len(after)
        if name == "secret_scan":
            assert set(after) == set(before)
            for i, t in before.items():
                at, out = 0, ""
                for a, b in spans[i]:
                    out, at = (out + t[at:a] + "[SECRET]", b) if a >= at else (out, max(at, b))
                assert after[i] == (out + t[at:] if spans[i] else t), i
        else:
            assert after == {"quality_rules": by_rules, "near_duplicates": by_copies, "decontamination": by_benchmark}[name](before), name
            assert 0 < len(after) <= len(before)
    places = pipeline.STAGES[-1][1](spark, kept, sf_dir)
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sizes = {}
    for r in places.collect():
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["length"]
    assert sizes == {i: len(model.encode(t or "")) + 1 for i, t in after.items()}
    empty = docs.limit(0)
    for name, stage in pipeline.STAGES:
        empty_out = stage(spark, empty, sf_dir)
        assert empty_out.count() == 0, name
    assert docs.select(F.count("doc_id")).first()[0] > 0
