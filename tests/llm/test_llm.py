"""The training-data operators against brute force on small fixtures: nulls, empties, long texts, ties, repeats."""

import itertools
import re
import zlib

import numpy as np
import pytest

from revlumen.llm import chunk_dedup, fuzzy_lines, hilbert, language, minhash, mixing, neighbours, phrase_index
from revlumen.llm import secret_ledger, token_store
from revlumen.llm.components import connected

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, node string, size string"


def docs_of(spark, texts, langs=None, sources=None):
    """Documents with clashing extra columns; one id and text comes twice where texts repeat their last row."""
    langs, sources = langs or ["en"] * len(texts), sources or ["s"] * len(texts)
    return spark.createDataFrame([(i, t, lang, s, 0, "x", "y") for i, (t, lang, s) in enumerate(zip(texts, langs, sources))], SCHEMA)


def words(rng, n, top=400):
    return " ".join(f"w{int(i)}" for i in rng.integers(0, top, n))


ODD = [None, "", "   ", "\n\n", "one", "one two", "É é"]


def test_empty_tables(spark, tmp_path):
    none = docs_of(spark, [])
    benchmark = spark.createDataFrame([], "item_id bigint, text string")
    assert secret_ledger.documents_query(spark, none).count() == 0
    assert hilbert.documents_query(none).count() == 0
    assert minhash.documents_query(none).count() == 0
    assert mixing.documents_query(none).count() == 0
    assert language.documents_query(none).count() == 0
    assert fuzzy_lines.documents_query(none).count() == 0
    assert chunk_dedup.documents_query(none).count() == 0
    assert phrase_index.documents_query(none, benchmark).count() == 0
    assert neighbours.embeddings_query(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_secrets(spark):
    texts = ODD + ["API_key = 'abcdef12' é AKIA" + "A" * 16, "secret=token: abcdefgh", "é" * 5 + "0a" * 12 + "x", "token=ab", "pass" * 9000]
    found = {r["doc_id"]: r for r in secret_ledger.documents_query(spark, docs_of(spark, texts + texts[-5:-4])).collect()}
    kinds = (("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
             ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24))
    for i, text in enumerate(texts):
        spans = sorted((m.start(), k, name, m.end()) for k, (name, pattern, group, least) in enumerate(kinds)
                       for m in re.finditer(pattern.replace("(password", "((?i:password").replace("key)", "key))", 1)
                                            if group else pattern, text or "") if len(m[group]) >= least)
        assert found[i]["spans"] == ",".join(f"{n}:{s}:{e}" for s, _, n, e in spans), i
    assert found[len(ODD) + 1]["n_assign"] == 0


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    path = str(tmp_path / "ledger")
    first = docs_of(spark, ["token=abcdefg", "plain", None])
    secret_ledger.scan_versions(first, ["doc_id"], path)
    assert spark.read.parquet(path).count() == 3
    more = docs_of(spark, ["token=abcdefg", "plain", "secret: zzzzzzz", "secret: zzzzzzz"])
    ledger = secret_ledger.read_ledger(spark, path)
    assert secret_ledger.scan_unseen(more.select("doc_id", "text"), ledger, ["doc_id"]).count() == 1
    found = secret_ledger.scan_versions(more, ["doc_id"], path)
    assert found.where("size(spans) = 1").count() == 3 and spark.read.parquet(path).count() == 4


def test_elias_fano():
    rng = np.random.default_rng(3)
    for n, top in itertools.product((0, 1, 63, 64, 65, 700), (1, 9, 50_000)):
        values = np.cumsum(rng.integers(0, top, n))
        code = token_store.EliasFano(token_store.EliasFano.encode(values))
        assert (code.values() == values).all() and [code.select(i) for i in range(n)] == values.tolist()


def test_token_store(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = np.random.default_rng(4)
    odd = ["".join(rng.choice(list(" \n\tab1.'é\x85"), 30)) for _ in range(60)]
    texts = ODD + ["a  b\n c", "<|endoftext|> x", "Don't stop, 12 34!!\nNow. " * 50] + odd
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = token_store.documents_query(docs_of(spark, texts)).orderBy("doc_id").collect()
    start = 0
    for row, text in zip(rows, texts, strict=True):
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes())), text
        start += len(ids)


def test_hilbert_curve_and_shards(spark):
    digits, following = hilbert.curve_table(3)

    def place(point, bits=2):
        state = index = 0
        for level in reversed(range(bits)):
            at = state * 8 + sum(((v >> level) & 1) << i for i, v in enumerate(point))
            index, state = index * 8 + digits[at], following[at]
        return index

    points = sorted(itertools.product(range(4), repeat=3), key=place)
    assert [place(p) for p in points] == list(range(64))
    assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(points, points[1:]))
    texts = ODD + ["same"] * 30
    rows = hilbert.documents_query(docs_of(spark, texts, sources=[None, "a", "b"] * 12 + ["a"])).collect()
    sizes = [sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(8)]
    assert sum(map(len, sizes)) == len(texts) and all(s == list(range(len(s))) for s in sizes)
    assert max(map(len, sizes)) - min(map(len, sizes)) <= 1
    assert {r["doc_id"]: r["size"] for r in rows}[0] == 1 and {r["doc_id"]: r["size"] for r in rows}[6] == 6


def test_minhash(spark):
    rng = np.random.default_rng(5)
    base = words(rng, 120)
    near = [" ".join(w if rng.random() > 0.02 else "new" for w in base.split()) for _ in range(25)]
    texts = ODD + [base, base.upper(), base, *near, words(rng, 90), words(rng, 20_000), "one two", "ONE  two"]
    hashes = minhash._Words()
    sets = [set(minhash.shingle_hashes(t, hashes).tolist()) for t in texts]
    label = list(range(len(texts)))
    for _ in texts:
        for a, b in itertools.combinations(range(len(texts)), 2):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                label[a] = label[b] = min(label[a], label[b])
    rows = {r["doc_id"]: r for r in minhash.documents_query(docs_of(spark, texts)).collect()}
    assert [rows[i]["component_id"] for i in range(len(texts))] == label
    assert [rows[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    kept = {r["doc_id"] for r in minhash.keep_one(docs_of(spark, texts)).collect()}
    assert kept == set(label)


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = dict(map(tuple, connected(spark.createDataFrame(pairs, "a int, b int")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}


def test_forward_sum():
    pieces = ["a", "b", "ab", "▁", "▁a", "ba", "aba", "é"]
    table = np.random.default_rng(6).random((8, 2))
    model = language.Model(["x", "y"], pieces, table / table.sum(axis=0))
    scorer = language.Scorer(model)

    def brute(word):
        if not word:
            return np.ones(2)
        total = np.zeros(2)
        for k in range(1, len(word) + 1):
            if word[:k] in pieces:
                total += model.probabilities[pieces.index(word[:k])] * brute(word[k:])
            elif k == 1:
                total += language.STRAY_CHARACTER * brute(word[1:])
        return total

    some = ["▁" + "".join(w) for n in range(5) for w in itertools.product("abz", repeat=n)]
    want = np.array([np.log(brute(w)) for w in some])
    assert np.allclose(scorer._block(some), want) and np.allclose([scorer._single(w) for w in some], want)
    assert scorer.texts(["", None, "12 ½", "ab" * 4000])[0][:3] == ["und"] * 3


def test_language_held_out(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.documents_query(documents).join(documents.select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.where("lang_pred = lang").count() >= 0.95 * found.count()


def test_mixing(spark):
    for seed in range(40):
        rng = np.random.default_rng(seed)
        lengths, counts = rng.choice(np.arange(1, 30), 4, replace=False), rng.integers(0, 4, 4)
        budget = int(rng.integers(0, 80))
        sums = {int(np.dot(t, lengths)) for t in itertools.product(*[range(c + 1) for c in counts])}
        taken = mixing._knapsack(lengths, counts, budget)
        assert (taken <= counts).all() and int(np.dot(taken, lengths)) == max(s for s in sums if s <= budget)
    rng = np.random.default_rng(8)
    texts = ODD + [words(rng, int(n)) for n in rng.integers(1, 60, 200)] + ["tied words"] * 80
    sources = [["a", "b", None, "c"][int(i)] for i in rng.choice(4, len(texts), p=[0.7, 0.1, 0.15, 0.05])]
    documents = docs_of(spark, texts, sources=sources)
    rows = mixing.documents_query(documents).collect()
    again = mixing.documents_query(documents.repartition(5)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    place = dict(enumerate(sources))
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}
    assert all(r["size"] == sizes[r["doc_id"]] and r["taken"] <= 3 * r["size"] for r in rows)
    targets = {place[r["doc_id"]]: (r["target"], r["source_size"]) for r in rows}
    assert sum(t for t, _ in targets.values()) == pytest.approx(sum(sizes.values()))
    for source, (target, size) in targets.items():
        taken = sum(r["taken"] for r in rows if place[r["doc_id"]] == source)
        assert abs(taken - target) <= 3 and target <= 3 * size + 1e-6
    assert mixing.mixed(documents).count() == sum(r["taken"] // r["size"] for r in rows if r["size"])


@pytest.mark.parametrize("size", [1e-100, 1e-39, 1.0, 1e39, 1e100])
def test_neighbours_of_any_size(spark, size):
    """Sizes beyond short floats, mixed sizes, rows without an id (last among ties), repeated rows."""
    rng = np.random.default_rng(12)
    vectors = rng.normal(size=(260, 24)) * size * np.where(rng.random(260) < 0.5, 1.0, 1e-3)[:, None]
    vectors[7] = vectors[9]
    data = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(None, vectors[9].tolist()), (None, (vectors[0] * 2).tolist()), (11, vectors[11].tolist())]
    got = neighbours.embeddings_query(spark.createDataFrame(data, "vec_id bigint, embedding array<double>").repartition(3)).collect()
    for q in range(0, 260, 20):
        scores = [(-float(np.einsum("ij,j->i", np.array([v]), vectors[q])[0]), i is None, i or 0, i) for i, v in data if i != q]
        own = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == q)
        assert own == [(n, x[3]) for n, x in enumerate(sorted(scores)[:20], 1)]


def test_neighbours_recall(spark):
    """Recall of the bounds against brute force, on clustered vectors of mixed lengths."""
    rng = np.random.default_rng(14)
    vectors = rng.normal(size=(40, 64))[rng.integers(0, 40, 6000)] + 0.3 * rng.normal(size=(6000, 64))
    vectors *= rng.choice([0.5, 1.0, 3.0], 6000)[:, None]
    data = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]) for r in neighbours.embeddings_query(data).collect()}
    scores = vectors[::20] @ vectors.T
    scores[np.arange(300), np.arange(0, 6000, 20)] = -np.inf
    want = {(q * 20, int(i)) for q, row in enumerate(np.argpartition(-scores, 20, axis=1)[:, :20]) for i in row}
    assert len(got) == 6000 and len(got & want) >= 0.99 * len(want)


def test_neighbours(spark):
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(300, 16)).astype(np.float32).tolist()
    vectors[3] = vectors[5]
    data = [(i, v) for i, v in enumerate(vectors)] + [(300, None), (301, [0.0] * 16), (302, [float("nan")] * 16), (303, [1.0])]
    got = neighbours.embeddings_query(spark.createDataFrame(data, "vec_id bigint, embedding array<float>")).collect()
    exact = np.array(vectors, np.float64)
    for q in range(0, 300, 20):
        scores = exact @ exact[q]
        want = sorted((i for i in range(300) if i != q), key=lambda i: (-scores[i], i))[:20]
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["vec_id"] for r in own] == want and np.allclose([r["score"] for r in own], scores[want])
    assert len(got) == 15 * 20


def test_fuzzy_lines(spark):
    rng = np.random.default_rng(10)
    line = words(rng, 60)
    changed = line.replace("w", "v", 1)
    texts = [*ODD, f"{line}\nfirst own", f"a\n{line.upper()}!\nb", f"{changed}\n--\n--", "x" * 50_000, "page 12\npage 34\nother"]
    got = {r["doc_id"]: r for r in fuzzy_lines.documents_query(docs_of(spark, texts)).collect()}
    n = len(ODD)
    assert got[0]["text"] is None and got[1]["text"] == "" and got[3]["text"] == "\n\n"
    assert got[n]["text"] == texts[n] and got[n + 1]["text"] == "a\nb" and got[n + 4]["text"] == "page 12\nother"
    assert got[n + 2]["text"] in ("--\n--", texts[n + 2])


def test_chunks_resist_insertions(spark):
    rng = np.random.default_rng(11)
    passage = words(rng, 80, 10_000)
    own = [words(rng, 200, 10_000) for _ in range(5)]
    texts = [*ODD, own[0] + " " + passage, "é " + own[1] + passage + own[2], own[3], own[4], "a" * 5000]
    documents = docs_of(spark, texts)
    found = {r["doc_id"]: r for r in chunk_dedup.documents_query(documents).collect()}
    n = len(ODD)
    assert {n, n + 1} <= found.keys() and not {n + 2, n + 3} & found.keys()
    assert found[n]["removed_chars"] == 0 and found[n + 1]["removed_chars"] > len(passage) / 2
    kept = {r["doc_id"]: r["text"] for r in chunk_dedup.without_repeats(documents).collect()}
    assert kept[n] == texts[n] and len(kept[n + 1]) == len(texts[n + 1]) - found[n + 1]["removed_chars"] and kept[0] is None
    chunker = chunk_dedup.Chunker()
    alone = [chunker.chunks([t.encode()])[4].tolist() for t in texts[n:n + 4]]
    assert sum(alone, []) == chunker.chunks([t.encode() for t in texts[n:n + 4]])[4].tolist()


def plain_chunks(text, gear):
    """Chunks of one text, byte by byte."""
    data = text.encode()
    places = [c for c in range(chunk_dedup.WINDOW, len(data))
              if sum(int(gear[data[c - 1 - k]]) << k for k in range(chunk_dedup.WINDOW)) % 65536 < chunk_dedup.BAR
              and data[c] & 0xC0 != 0x80]
    ends = [c for at, c in enumerate(places) if not at or c - places[at - 1] >= chunk_dedup.LEAST_CHUNK] + [len(data)]
    chunks, start = [], 0
    for end in ends if data else []:
        while start < end:
            cut = end if end - start <= chunk_dedup.MOST_CHUNK else start + chunk_dedup.MOST_CHUNK
            while cut < end and data[cut] & 0xC0 == 0x80:
                cut -= 1
            chunks.append((len(data[:start].decode()), data[start:cut]))
            start = cut
    return chunks


def test_chunks_against_plain_python(spark):
    rng = np.random.default_rng(29)
    passage, other = words(rng, 70, 10_000), "é".join(words(rng, 60, 10_000).split())
    texts = [*ODD, words(rng, 90, 10_000) + passage, passage, "é" + passage + words(rng, 40, 10_000) + other, other, "b" * 3000,
             words(rng, 100, 10_000), words(rng, 5000, 10_000) + passage]
    listed = [(i, t) for i, t in enumerate(texts)] + [(len(ODD), texts[len(ODD)])] * 3 + [(None, passage), (2, other + " end")]
    gear = chunk_dedup.Chunker().gear
    cut = [(i, t, *chunk) for i, t in listed for chunk in plain_chunks(t or "", gear)]
    times, firsts = {}, {}
    for i, t, start, octets in cut:
        times[octets] = times.get(octets, 0) + 1
        firsts[octets] = min(firsts.get(octets, (np.inf,)), (-1 if i is None else i, start))
    expected = []
    for i, t in dict.fromkeys(listed):
        runs = []
        for start, octets in plain_chunks(t or "", gear):
            if times[octets] > 1:
                if not runs or runs[-1][-1][1] != start:
                    runs.append([])
                first = firsts[octets]
                runs[-1].append((start, start + len(octets.decode()), len(octets), first[0], first != (-1 if i is None else i, start)))
        runs = [r for r in runs if sum(c[2] for c in r) >= chunk_dedup.LEAST_RUN]
        if runs:
            flat = [c for r in runs for c in r]
            expected.append((i, len(runs), sum(c[1] - c[0] for c in flat), sum(c[1] - c[0] for c in flat if c[4]),
                             ",".join(f"{r[0][0]}:{r[-1][1]}" for r in runs), sorted({c[3] for c in flat} - {-1})))
    schema = "doc_id bigint, text string, start string, size int, run int"
    documents = spark.createDataFrame([(i, t, "x", 0, 0) for i, t in listed], schema)
    got = [(r["doc_id"], r["n_passages"], r["repeated_chars"], r["removed_chars"], r["passages"], r["first_doc_ids"])
           for r in chunk_dedup.documents_query(documents).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert len(got) >= 6


def test_phrases(spark):
    rng = np.random.default_rng(12)
    item = words(rng, 25)
    texts = [*ODD, "x " + item.upper() + " y", "! " + " ".join(item.split()[3:13]), " ".join(item.split()[3:12]), words(rng, 3000), "short one two three"]
    benchmark = spark.createDataFrame([("q1", item), ("q2", "two three"), ("q0", None), ("q3", "--"), ("q1", item)], "item_id string, text string")
    rows = {r["doc_id"]: r for r in phrase_index.documents_query(docs_of(spark, texts + texts[-1:]), benchmark).collect()}
    n = len(ODD)
    hits = [rows[n + i]["n_hit"] for i in range(5)]
    assert hits == [25, 10, 0, 0, 2] and rows[n]["n_words"] == 27 and rows[0]["n_words"] == 0
    postings = phrase_index.build_index(docs_of(spark, texts), phrase_index.item_words(benchmark))
    pairs = phrase_index.rarest_pairs(postings, phrase_index.item_words(benchmark))
    assert phrase_index.proximity_matches(postings, pairs, 2).where("stray = 0").count() >= 2


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        following = stage(spark, documents, folder)
        assert following.columns == documents.columns
        documents = spark.createDataFrame(following.collect(), following.schema)
    assert 0 < documents.count()
    assert corpus_pipeline.run(spark, folder).count() == documents.count()


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def linked(texts):
    """The first text of each group that edit similarity 0.9 connects."""
    plains, label = [fuzzy_lines.normalised(t) for t in texts], list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = plains[i], plains[j]
        longer = max(len(a), len(b))
        if 10 * abs(len(a) - len(b)) <= longer and label[i] != label[j] and 10 * edit_distance(a, b) <= longer:
            low, high = sorted((label[i], label[j]))
            label = [low if x == high else x for x in label]
    return label


def edited(rng, line, edits):
    letters = list("abcdefghijklmnopqrstuvwxyz")
    for _ in range(edits):
        at, how = int(rng.integers(len(line))), int(rng.integers(3))
        line = line[:at] + (str(rng.choice(letters)) if how else "") + line[at + (how != 1):]
    return line


def test_fuzzy_lines_verify_all_that_share_a_block(spark):
    simhash, plenty = fuzzy_lines.SimHash(), 0
    rng = np.random.default_rng(21)
    names = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(4000)]
    texts = []
    for trial in range(20_000):
        line = [names[int(i)] for i in rng.integers(0, 4000, 4)]
        other = [line[0][:-1] + "é", *line[1:]]
        a, b = simhash.blocks(line), simhash.blocks(other)
        if (a.view(">u4") == b.view(">u4")).any() and int(np.unpackbits(a ^ b).sum()) > 48:
            texts += [" ".join(line), " ".join(other)]
            plenty += 1
        if plenty == 3:
            break
    assert plenty == 3
    rows = {r["doc_id"]: r for r in fuzzy_lines.documents_query(docs_of(spark, texts)).collect()}
    assert [rows[i]["n_removed"] for i in range(6)] == [0, 1] * 3


def test_pair_parities_lose_no_link():
    rng = np.random.default_rng(22)
    for n in (4, 9, 20, 60):
        line = words(rng, n)
        for edits in range(1, 8):
            other = edited(rng, line, edits)
            a, b = fuzzy_lines.pair_parities([line, other])
            assert int(np.unpackbits((a ^ b).view(np.uint8)).sum()) <= 4 * edits


def test_fuzzy_lines_equal_brute_force(spark):
    rng = np.random.default_rng(23)
    names = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(n))) for n in rng.integers(1, 9, 3000)]
    texts = []
    for n in (4, 5, 6, 8, 10, 15, 20, 30, 45, 60):
        for _ in range(4):
            line = " ".join(names[int(i)] for i in rng.integers(0, 3000, n))
            # As many edits as are allowed, and a few more or less, all over the line.
            texts += [line, *[edited(rng, line, max(1, len(line) // 10 + d)) for d in (-9, -3, -1, 0, 1)]]
            spread = list(line)
            spread[9::10] = "#" * len(spread[9::10])
            texts.append("".join(spread).replace("#", "q"))
    label = linked(texts)
    assert len(set(label)) < len(texts) / 2
    rows = {r["doc_id"]: r for r in fuzzy_lines.documents_query(docs_of(spark, texts)).collect()}
    assert [i for i in range(len(texts)) if not rows[i]["n_removed"]] == sorted(set(label))


def test_gram_tests_lose_no_link():
    rng = np.random.default_rng(25)
    for n in (4, 9, 20, 60):
        line = words(rng, n)
        for edits in range(1, 8):
            texts = [line, edited(rng, line, edits)]
            a, b = fuzzy_lines.pair_parities(texts, fuzzy_lines.GRAM, fuzzy_lines.GRAM_WORDS)
            most = 2 * fuzzy_lines.GRAM * edits
            assert int(np.unpackbits((a ^ b).view(np.uint8)).sum()) <= most
            assert fuzzy_lines.gram_gaps(texts, np.array([0]), np.array([1]))[0] <= most


def test_plain_lines_are_normalised():
    for text in ("a_B9\n\n  \x85x\xa0y\r\n", "ÀÉß ªº²\nµ Ÿ", "Σ ΑΣ\nΣΑ 12", "".join(map(chr, range(1, 0x250)))):
        assert fuzzy_lines.plain_lines(text) == [fuzzy_lines.normalised(line) for line in text.split("\n")]


def test_simhash_of_many_lines():
    simhash, rng = fuzzy_lines.SimHash(), np.random.default_rng(26)
    lines = [words(rng, int(n)).split(" ") for n in (1, 2, 3, 254, 255, 256, 257, 5000, 7)]
    assert (simhash.many(lines) == np.array([simhash.blocks(line) for line in lines])).all()
    assert simhash.many([]).shape == (0, 32)


def test_fuzzy_lines_are_dealt_whole(spark, monkeypatch):
    rng = np.random.default_rng(27)
    plains = []
    for _ in range(12):
        line = words(rng, int(rng.integers(4, 40)))
        plains += [line, *[edited(rng, line, int(rng.integers(1, max(2, len(line) // 9)))) for _ in range(4)]]
    plains = sorted({fuzzy_lines.normalised(p) for p in plains})
    cells = fuzzy_lines.Segments(0.9).cells(np.array([len(p) for p in plains])).tolist()
    texts = spark.createDataFrame([(p.encode(), p, len(p), c) for p, c in zip(plains, cells)],
                                  "node binary, plain string, size int, cell int")
    one = plains[0].encode()
    components = spark.createDataFrame([(one, one)], "node binary, component binary")
    # A few rows per line, not some per character.
    assert fuzzy_lines.dealt_lines(texts, components).count() <= 3 * len(plains) + 3
    want = {(a, b) for a, b in itertools.combinations(plains, 2) if abs(len(a) - len(b)) * 10 <= max(len(a), len(b))
            and 10 * edit_distance(a, b) <= max(len(a), len(b))}
    for block in (1 << 24, 150):
        monkeypatch.setattr(fuzzy_lines, "BLOCK_CHARS", block)
        got = {tuple(sorted((r["plain_a"], r["plain_b"])))
               for r in fuzzy_lines.segment_pairs(texts, components, 0.9).collect()}
        assert want <= got
    # Nothing meets within a component.
    every = spark.createDataFrame([(p.encode(), one) for p in plains], "node binary, component binary")
    assert fuzzy_lines.segment_pairs(texts, every, 0.9).count() == 0


def test_edit_distances_within_bounds():
    rng = np.random.default_rng(28)
    for letters in ("ab", "abc\u00e9", "ab\u4e00", "a\U0001f600b"):
        lines = []
        for _ in range(25):
            line = "".join(rng.choice(list(letters), int(rng.integers(1, 40))))
            lines += [line, edited(rng, line + "a", int(rng.integers(0, 6)))]
        lines = [line or "a" for line in lines]
        texts = fuzzy_lines._Texts([fuzzy_lines.pa.array(lines[:20]), fuzzy_lines.pa.array(lines[20:])])
        assert [texts.plain(i) for i in range(50)] == lines
        a, b = np.divmod(np.arange(2500), 50)
        most = rng.integers(0, 12, 2500)
        want = [edit_distance(lines[i], lines[j]) <= m for i, j, m in zip(a, b, most)]
        assert fuzzy_lines.within(texts, a, b, most).tolist() == want


def test_fuzzy_lines_that_repeat_themselves(spark):
    rng = np.random.default_rng(29)
    texts = [edited(rng, "is onhe " * 30 + "x", int(n)) for n in rng.integers(5, 60, 40)]
    rows = {r["doc_id"]: r for r in fuzzy_lines.documents_query(docs_of(spark, texts)).collect()}
    assert [i for i in range(40) if not rows[i]["n_removed"]] == sorted(set(linked(texts)))


def test_repeated_keys_meet_a_line_once(monkeypatch):
    hits, goes_on = [], fuzzy_lines._Index._goes_on
    monkeypatch.setattr(fuzzy_lines._Index, "_goes_on", lambda self, a, *x: hits.append(len(a)) or goes_on(self, a, *x))
    lines = ["is onhe " * 100 + f"x{'y' * n}" for n in range(20)]
    texts, segments = fuzzy_lines._Texts([fuzzy_lines.pa.array(lines)]), fuzzy_lines.Segments(0.9)
    cells = segments.cells(texts.sizes)
    first = int(np.flatnonzero(cells == cells[-1])[0])
    groups = fuzzy_lines._Groups(np.arange(20))
    index = fuzzy_lines._Index(segments, int(cells[-1]), texts, first, 20, groups.above.copy())
    a, b = np.divmod(index.meet(0, 20, groups), 20)
    # All pairs by few hits, not by one for each place of either line.
    assert {(int(x), int(y)) for x, y in zip(a, b)} >= {(x, y) for x in range(first, 20) for y in range(x)}
    assert sum(hits) < 20 * 20 * 10


def test_first_places_with_null_and_repeated_ids(spark):
    rng = np.random.default_rng(30)
    line = words(rng, 30)
    rows = [(7, f"own one\n{line}"), (7, f"own one\n{line}"), (None, f"z\n{line} y"), (3, line), (7, f"{line}\n{line}")]
    got = fuzzy_lines.documents_query(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    kept = sorted((r["doc_id"] or 0, r["n_lines"], r["n_removed"], r["text"]) for r in got)
    assert kept == [(0, 2, 0, f"z\n{line} y"), (3, 1, 1, ""), (7, 2, 1, "own one"), (7, 2, 1, "own one"), (7, 2, 2, "")]


def test_mixing_very_long_documents():
    assert mixing.fit(np.array([100_000]), np.array([3]), 120_000).tolist() == [1]
    assert mixing.fit(np.array([100_000]), np.array([3]), 190_000).tolist() == [2]
    assert mixing.fit(np.array([100_000, 110_000, 130_000]), np.array([1, 1, 1]), 120_000).tolist() == [0, 1, 0]
    rng = np.random.default_rng(24)
    for _ in range(200):
        lengths = rng.choice(np.arange(20_000, 300_000), 4, replace=False)
        counts = rng.integers(0, 4, 4)
        budget = int(rng.integers(0, int(lengths.sum()) * 2))
        sums = [int(np.dot(t, lengths)) for t in itertools.product(*[range(c + 1) for c in counts])]
        taken = mixing.fit(lengths, counts, budget)
        missed = abs(int(np.dot(taken, lengths)) - budget)
        assert (taken >= 0).all() and (taken <= counts).all()
        assert budget >= max(sums) or missed <= min(max(lengths), budget)
        # One document more or fewer is never nearer.
        for i, length in enumerate(lengths):
            for step in (-1, 1):
                if 0 <= taken[i] + step <= counts[i]:
                    assert abs(int(np.dot(taken, lengths)) + step * int(length) - budget) >= missed


def test_pipeline_equals_plain_python(spark, tmp_path):
    import collections

    import corpus_pipeline

    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    given = [r.asDict() for r in real.where("length(text) > 300").orderBy("doc_id").limit(60).collect()]
    item = words(np.random.default_rng(41), 25)
    top = max(r["doc_id"] for r in given)
    extra = [{**r, "text": r["text"].upper()} for r in given[:4]] + [{**r, "text": r["text"] + " end"} for r in given[4:8]]
    extra += [{**r, "text": r["text"] + " " + item} for r in given[8:10]] + [{**given[0], "text": t} for t in (None, "", "12 34")]
    docs = given + [{**r, "doc_id": top + 1 + i} for i, r in enumerate(extra)]
    spark.createDataFrame([tuple(r[c] for c in real.columns) for r in docs], real.schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("q", item)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    scorer = language.Scorer(language.learned_from(spark.read.parquet(str(tmp_path / "documents.parquet"))))
    names, certain = scorer.texts([r["text"] for r in docs])
    docs = [r for r, name, c in zip(docs, names, certain) if name != language.UNKNOWN and c >= 0.5]
    assert len(docs) >= 60
    hashes = minhash._Words()
    sets = [set(minhash.shingle_hashes(r["text"], hashes, 5).tolist()) for r in docs]
    label = list(range(len(docs)))
    for a, b in itertools.combinations(range(len(docs)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
    docs = [r for i, r in enumerate(docs) if label[i] == i]

    def windows(text):
        found = re.findall(r"[0-9a-z\x80-\U0010FFFF]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        return {tuple(found[i:i + 10]) for i in range(len(found) - 9)}

    docs = [r for r in docs if not windows(r["text"]) & windows(item)]
    assert 50 <= len(docs) < 68
    rows = [r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    times, about = collections.Counter(rows), {r["doc_id"]: (r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))) for r in docs}
    assert times.keys() <= about.keys()
    sizes = collections.Counter()
    for source, size in about.values():
        sizes[source] += size
    weight = {s: 1 + i % 3 for i, s in enumerate(sorted(sizes))}
    full = set()
    while True:
        open_ = [s for s in sizes if s not in full]
        level = (sum(sizes.values()) - sum(3 * sizes[s] for s in full)) / sum(weight[s] for s in open_)
        more = {s for s in open_ if 3 * sizes[s] <= weight[s] * level}
        if not more:
            break
        full |= more
    got = collections.Counter()
    for doc, n in times.items():
        got[about[doc]] += n
    for source in sizes:
        target = min(3 * sizes[source], weight[source] * level)
        counts = collections.Counter(size for s, size in about.values() if s == source)
        lengths = np.array(sorted(counts))
        n = np.array([counts[x] for x in lengths])
        passes = min(round(target) // sizes[source], 3)
        extra = mixing.fit(lengths, n, round(target) - passes * sizes[source]) if passes < 3 else 0 * n
        assert [got[source, int(x)] for x in lengths] == (passes * n + extra).tolist()
        assert all(passes <= times[d] <= passes + 1 for d, (s, _) in about.items() if s == source)


def test_minhash_links_equal_all_pairs(spark):
    """Groups around a base, with texts near and below the bar: components of all pairs, and no link is missed."""
    rng = np.random.default_rng(77)
    texts = []
    for size, rate in ((60, 0.03), (60, 0.05), (200, 0.02), (200, 0.035), (400, 0.03), (30, 0.06)):
        base = words(rng, size).split()
        texts += [" ".join(w if rng.random() > rate else words(rng, 1) for w in base) for _ in range(40)]
    hashes = minhash._Words()
    sets = [set(minhash.shingle_hashes(t, hashes).tolist()) for t in texts]
    label = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
    assert 20 < len(set(label)) < 220
    rows = {r["doc_id"]: r["component_id"] for r in minhash.documents_query(docs_of(spark, texts)).collect()}
    assert [rows[i] for i in range(len(texts))] == label


def test_minhash_keeps_one_of_repeated_ids(spark):
    base = words(np.random.default_rng(9), 100)
    docs = spark.createDataFrame([(1, base), (1, base + " end"), (2, base), (None, base), (3, "other words only"), (1, base)],
                                 "doc_id long, text string")
    assert sorted(r["doc_id"] for r in minhash.keep_one(docs).collect()) == [1, 3]


def test_minhash_prefix_join_lists_few_unlinked_pairs(spark, monkeypatch):
    """Texts a bit below the bar around one base share the shingles of their prefixes; nearly none is a candidate."""
    rng = np.random.default_rng(79)
    base, texts = words(rng, 150).split(), []
    for i in range(60):
        at = rng.choice(30, 3, replace=False) * 5 + 2
        texts.append(" ".join(f"own{i}x{j}" if j in at else w for j, w in enumerate(base)))
    texts.append(texts[0] + " end")
    hashes, listed, label = minhash._Words(), [], list(range(len(texts)))
    sets = [minhash.shingle_hashes(t, hashes) for t in texts]
    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(np.intersect1d(sets[a], sets[b]))
        if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
    prefix_pairs = minhash.prefix_pairs

    def counted(*args):
        pairs = prefix_pairs(*args)
        listed.append(pairs.count())
        return pairs

    monkeypatch.setattr(minhash, "prefix_pairs", counted)
    rows = {r["doc_id"]: r["component_id"] for r in minhash.documents_query(docs_of(spark, texts)).collect()}
    assert len(listed) == 1 and listed[0] <= 60
    assert [rows[i] for i in range(len(texts))] == label and 10 < len(set(label)) < 60


def test_set_parities_lose_no_link():
    rng = np.random.default_rng(80)
    hashes = minhash._Words()
    for size in (1, 30, 150, 900, 4000):
        for _ in range(20):
            base = words(rng, size, 4000).split()
            other = [w if rng.random() > 0.04 else "own" for w in base]
            a, b = (minhash.shingle_hashes(" ".join(x), hashes) for x in (base, other))
            odd = minhash.set_parities(a) ^ minhash.set_parities(b)
            assert sum(int(x).bit_count() for x in odd.view(np.uint64)) <= len(np.setxor1d(a, b))
