"""The text operators against brute force, the public libraries, and their defined results for odd input."""

import base64
import collections
import gzip
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import sentencepiece.sentencepiece_model_pb2 as model_format
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidegauge.llm import (bagminhash, compression, fingerprints, langid, licenses, packing, pieces, queries, suffix,
                           tokencount, warc)

SF = "/root/testdata/sf0.001"
PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"word{i * i % 997}" for i in range(30_000))
SHARED = "a passage that several of these documents hold word for word " * 5
ODD = [(1, None), (2, ""), (3, "  a  b\n\tc ﬁ é <s> ▁▁x <|endoftext|> x"), (4, LONG), (5, "🙂 漢字 \x00 " + "ha" * 200), (6, SHARED + "one"),
       (6, SHARED + "two"), (7, "equal rows " * 40), (7, "equal rows " * 40), (None, "no key, " + SHARED),
       (8, "Licensed under CC BY-NC 4.0."), (9, "12 34 ... --"), (10, "Under The MIT License under the mit license")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ODD, "doc_id BIGINT, text STRING")
    return rows.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.char_length("text").cast("bigint").alias("n_chars"),
                       F.lit(1).alias("n_bytes"), F.lit(2).alias("row"), F.lit("x").alias("raw"), F.lit(0).alias("id"), F.lit(0).alias("n")).repartition(3)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs(rows):
    return [(r["doc_id"], r["text"] or "") for r in rows.select("doc_id", "text").collect()]


def bag(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("make", [
    lambda d: packing.packed_documents(d, WORDS), suffix.removed_repeats, lambda d: pieces.encode_digests(d, PIECES), licenses.license_scan,
    lambda d: langid.identify(d, langid.train(d)), bagminhash.near_duplicates, fingerprints.edited_likeness,
    lambda d: tokencount.token_counts(d, PIECES), compression.quality_facts])
def test_empty_tables(odd, make):
    assert make(odd.filter("false")).count() == 0


def test_pieces_equal_the_library(odd, documents):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for rows in (odd, documents):
        want = []
        for key, text in pairs(rows):
            ids = library.encode(text)
            want.append((key, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                         hashlib.sha256(library.decode(ids).encode()).hexdigest(), len(text.encode())))
        got = pieces.encode_digests(rows, PIECES).drop("spans_crc32").collect()
        assert bag(got) == bag(want)
        counts = [(key, len(text.encode()), len(ids := library.encode(text)), len(ids) > 4096) for key, text in pairs(rows)]
        assert bag(tokencount.token_counts(rows, PIECES).collect()) == bag(counts)


def test_spans_of_pieces(odd):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = [(key, *zip(*[(p.id, p.begin, p.end) for p in library.encode(text, return_type="proto").pieces])) if text else (key,)
            for key, text in pairs(odd)]
    got = [(r[0], *(tuple(x) for x in r[1:] if x)) for r in pieces.encode(odd, PIECES).collect()]
    assert bag(got) == bag(want)


def test_character_map_takes_the_longest_prefix():
    spec = model_format.NormalizerSpec()
    spec.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_normalizer_spec())
    model = pieces.Pieces(open(PIECES, "rb").read())
    model.map = pieces.CharacterMap(spec.precompiled_charsmap)
    normal, starts = model.normalise("ﬁ ｶﾞ① Å")
    assert normal == "▁fi▁ガ1▁Å" and starts.tolist() == [0, 0, 0, 3, 4, 10, 13, 14, 16]


def test_packing_covers_every_id_once(odd, documents):
    library = Tokenizer.from_file(WORDS)
    for rows in (odd, documents):
        want = []
        for key, text in pairs(rows):
            ids = np.array(library.encode(text, add_special_tokens=False).ids + [0], "<u4")
            want += [(key, i // 2048, i, len(ids[i:i + 2048]), zlib.crc32(ids[i:i + 2048].tobytes())) for i in range(0, len(ids), 2048)]
        got = packing.packed_documents(rows, WORDS).collect()
        assert bag(r[:5] for r in got) == bag(want)
        held = collections.defaultdict(list)
        for r in got:
            held[r["sequence_id"]].append((r["offset"], r["length"]))
        for places in held.values():
            end = 0
            for offset, length in sorted(places):
                assert offset == end
                end += length
            assert end <= 2048
        assert len(held) <= -(-sum(r["length"] for r in got) // 2048) + 1


def test_islands_join_over_small_blocks(spark):
    rows = spark.range(900).select("id", (F.pmod(F.xxhash64("id"), F.lit(900)) + 1).alias("length"))
    got = packing.pack(rows, 1000, block=200).collect()
    assert sorted(r["id"] for r in got) == list(range(900))
    assert len({r["sequence_id"] for r in got}) <= 1.04 * sum(r["length"] for r in got) / 1000 + 5


def brute_repeats(rows, length):
    seen = collections.Counter(raw[i:i + length] for _, raw in rows for i in range(len(raw) - length + 1))
    for key, raw in rows:
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if seen[raw[i:i + length]] > 1:
                gone[i:i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        yield key, len(raw), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()


def test_repeats_equal_brute_force(odd, documents):
    for rows in (odd, documents):
        want = list(brute_repeats([(k, t.encode()) for k, t in pairs(rows)], 200))
        assert bag(suffix.removed_repeats(rows).collect()) == bag(want)


def test_large_groups_of_contexts_are_counted_string_by_string(spark):
    rng, core = np.random.default_rng(3), "the same core of a passage stands in all of these documents"
    texts = [(i, "".join(rng.choice(list("abc "), 30)) + core + "".join(rng.choice(list("ab"), 4)) + " tail") for i in range(60)]
    rows = spark.createDataFrame(texts, "row BIGINT, raw STRING").withColumn("raw", F.encode("raw", "UTF-8"))
    starts = lambda group: {(r["row"], i) for r in suffix.repeated_spans(rows, 66, 20, group).collect()
                            for i in range(r["first"], r["end"])}
    seen = collections.Counter(t.encode()[i:i + 66] for _, t in texts for i in range(len(t) - 65))
    want = {(k, i) for k, t in texts for i in range(len(t) - 65) if seen[t.encode()[i:i + 66]] > 1}
    assert want and starts(4096) == want == starts(2)


def test_suffix_sort_orders_like_bytes():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 600).astype(np.uint8)
    order = suffix.SuffixSort(data, 12).sort(np.arange(580), np.array([0, 200, 580]))
    for part in (order[:200], order[200:]):
        words = [data[i:i + 12].tobytes() for i in part]
        assert words == sorted(words)


def test_stretches_of_long_texts_meet(monkeypatch):
    monkeypatch.setattr(suffix, "STRETCH", 700)
    raw = LONG.encode()[:5000]
    _, _, first, end, place = suffix.text_blocks(raw)
    assert sorted(x for a, b in zip(first, end) for x in range(a, b)) == list(range(len(raw) - 199))
    assert all(a <= p for a, p in zip(first, place))


def test_cut_texts_stay_valid():
    raw = "aé漢b".encode()
    gone = np.zeros(len(raw), bool)
    gone[2:6] = True
    assert suffix.kept_text(raw, gone) == "aéb"


def test_license_labels(odd):
    rows = {r["doc_id"]: r for r in licenses.license_scan(odd).collect()}
    assert (rows[8]["base_labels"], rows[8]["labels"], rows[8]["n_base"], rows[8]["first_word"]) == ("cc-by-nc", "cc-by-nc", 1, 2)
    assert (rows[10]["n_base"], rows[10]["first_word"], rows[10]["last_word"], rows[10]["score"]) == (2, 0, 4, 1.0)
    assert tuple(rows[1])[1:] == (0, 0, None, None, "", "", 0.0)


def brute_join(scan, words):
    """All (start, block, template, share) by comparing every block with every template."""
    sets = [licenses.tokens_of(licenses.words_of(body)) for _, body in scan.templates]
    for number, ((label, body), tokens) in enumerate(zip(scan.templates, sets)):
        block = scan.block
        while block < 2 * len(licenses.words_of(body)):
            block *= 2
        twins = [len(tokens & other) for (name, _), other in zip(scan.templates, sets) if name != label and not tokens <= other]
        for start in range(0, max(1, len(words)), block // 2):
            held = len(tokens & licenses.tokens_of(words[start:start + block]))
            if held >= scan.threshold * len(tokens) and held > max(twins):
                yield start, block, number, held / len(tokens)


@pytest.mark.parametrize("threshold", [0.5, 0.85])
def test_license_join_is_exact(threshold):
    scan, rng = licenses.Scan(threshold=threshold), np.random.default_rng(5)
    index = licenses.TemplateIndex(scan, {b"the": 50, b"under": 30, (b"of", b"the"): 20})
    bodies = [licenses.words_of(body) for _, body in scan.templates]
    vocabulary = sorted({w for body in bodies for w in body})
    found = 0
    for _ in range(150):
        words = []
        for i in rng.integers(0, len(bodies), rng.integers(0, 6)):
            words += [b"x"] * rng.integers(0, 50) + [vocabulary[j] for j in rng.integers(0, len(vocabulary), rng.integers(0, 30))]
            body = list(bodies[i])
            for j in rng.integers(0, len(body), rng.integers(0, 3)):
                body[j] = b"other"
            words += body
        want = sorted(brute_join(scan, words))
        found += len(want)
        assert sorted(index.joined(words)) == want
    assert found > 300


def test_every_license_of_a_block_counts(spark):
    gpl, lgpl = "This work is licensed under the GNU General Public License, version ", "This work is licensed under the GNU Lesser General Public License. "
    texts = {
        gpl + "2 or licensed under the GNU General Public License, version 3.": "gpl-2,gpl-3", gpl + "3.": "gpl-3", gpl + "2.": "gpl-2",
        lgpl: "lgpl", lgpl + gpl + "2.": "gpl-2,lgpl", gpl + "3. " + lgpl: "gpl-3,lgpl", gpl + "2. " + lgpl + gpl + "3.": "gpl-2,gpl-3,lgpl",
        "Licensed under CC BY 4.0": "cc-by", "Licensed under CC BY-SA 4.0": "cc-by-sa",
        "Licensed under CC BY 4.0. Licensed under CC BY-SA 4.0": "cc-by,cc-by-sa",
        "Licensed under CC BY-SA 4.0 or CC BY 4.0.": "cc-by,cc-by-sa", "Released under the MIT license. " + gpl + "2": "gpl-2,mit",
        "This software is distributed to all.": ""}
    # Wherever the blocks' edges fall; a passage longer than half a block may be cut, so only the others are moved.
    cases = [("some other words " * (n // 3) + "x " * (n % 3) + t + " and more words" * 9, want) for t, want in texts.items()
             for n in (range(0, 45) if len(licenses.words_of(t)) <= 20 else [0])]
    # Bodies, with words changed here and there, lie whole in blocks of their own length.
    for label, body in licenses.TEMPLATES:
        words = body.split()
        if len(words) > 40:
            words[len(words) // 2] = "changed"
            cases += [("other words " * n + " ".join(words), label) for n in range(0, 200, 17)]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id BIGINT, text STRING")
    got = {r["doc_id"]: r["labels"] for r in licenses.license_scan(rows).collect()}
    assert [(t, got[i]) for i, (t, _) in enumerate(cases) if got[i] != cases[i][1]] == []


def test_gru_gradients_and_accuracy(spark):
    network = langid.Network(["a", "b"], 5, 3)
    for owner, name in network.weights():
        setattr(owner, name, getattr(owner, name).astype(np.float64))
    codes, keep = langid.padded([b"abc", b"de", b"xyzzy"])
    lang = np.array([0, 1, 1])
    _, grads = network.gradients(codes, keep, lang)
    for (owner, name), grad in zip(network.weights(), grads):
        at, weight = np.unravel_index(np.abs(grad).argmax(), grad.shape), getattr(owner, name)
        value, slopes = weight[at], []
        for step in (1e-3, -1e-3):
            weight[at] = value + step
            slopes.append(network.gradients(codes, keep, lang)[0])
        weight[at] = value
        assert abs(grad[at] - (slopes[0] - slopes[1]) / 2e-3) < 1e-5
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs, langid.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert found.filter("lang = lang_pred").count() >= 0.98 * found.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found.collect())


def test_language_sample_ignores_copies_and_partitions(documents):
    how = langid.Training(docs=20, windows=300, epochs=1)
    known = documents.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~langid.held_out("doc_id"))
    one = known.orderBy("doc_id").limit(1)
    copies = one.withColumn("doc_id", F.explode(F.sequence(F.lit(1_000_000), F.lit(1_000_600)).cast("array<bigint>")))
    first = langid.train(known.repartition(7), how)
    many = langid.train(known.unionByName(copies).coalesce(1), how)
    assert first.langs == many.langs
    assert all(np.array_equal(getattr(x, n), getattr(y, n)) for (x, n), (y, _) in zip(first.weights(), many.weights()))


def test_languages_of_odd_texts(odd):
    rows = {r["doc_id"]: r for r in langid.identify(odd, langid.train(odd)).collect()}
    assert [rows[i]["lang_pred"] for i in (1, 2, 9)] == ["und"] * 3 and rows[4]["lang_pred"] == "en"


def test_numerals_are_no_letters():
    assert langid.has_letter("x² Ⅳ") and not any(map(langid.has_letter, ["12 ² ① Ⅳ ½", "", None, "... 7"]))


def test_windows_label_as_the_uncut_text_does(documents):
    network = langid.train(documents, langid.Training(docs=100, windows=2000, epochs=2))
    texts = [t.lower().encode() for _, t in pairs(documents) if len(t) > 1200][:40] + [b"z", b"ab" * langid.WINDOW, b"q" * (langid.WINDOW + 1)]
    for raw, sums in zip(texts, langid.Predictor(network).sums(texts)):
        whole = network.positions(np.frombuffer(raw, np.uint8)[None]).sum(axis=(0, 1))
        # Every byte is labelled once, by states that have run on for long enough.
        assert abs(sums.sum() - len(raw)) < 1e-3 * len(raw) and np.abs(whole - sums).max() < 0.01 * len(raw)


def test_training_reads_from_anywhere_and_bounds_languages(spark):
    # Only what follows a long common head tells the languages apart.
    head = "0123456789 " * 50
    rows = [(i, head + ("alpha beta gamma " if i % 2 else "uno dos tres ") * 300 + str(i), "ab"[i % 2]) for i in range(60)]
    rows += [(1000 + i, f"junk {i}", f"label{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING")
    network = langid.train(docs, langid.Training(chars=500, langs=2, windows=400))
    assert network.langs == ["a", "b"]
    found = langid.identify(docs.filter("doc_id < 1000"), network).join(docs.select("doc_id", "lang"), "doc_id")
    assert found.filter("lang != lang_pred").count() == 0


def shingles(text):
    words = text.split()
    return collections.Counter(zip(*[words[i:] for i in range(min(5, len(words)))])) if words else collections.Counter()


def brute_classes(rows):
    bags, parent = [(k, shingles(t)) for k, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(bags):
        for j in range(i):
            b = bags[j][1]
            if a == b or (a & b).total() >= 0.8 * (a | b).total():
                parent[root(i)] = root(j)
    classes = collections.defaultdict(list)
    for i, (key, _) in enumerate(bags):
        classes[root(i)].append(key)
    return sorted(sorted(c, key=str) for c in classes.values())


@pytest.mark.parametrize("per_band, bands", [(4, 24), (1, 24)])
def test_near_duplicates_equal_brute_force(spark, per_band, bands):
    rng = np.random.default_rng(8)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 900, 120)) for _ in range(3)]
    texts = [(i, b) for i, b in enumerate(base)]
    for i in range(60):
        words = base[i % 3].split()
        for at in rng.integers(0, 120, rng.integers(1, 7)):
            words[at] = f"e{rng.integers(0, 40)}"
        texts.append((10 + i, " ".join(words)))
    texts += [(100, None), (101, ""), (102, "one two"), (103, "one two"), (104, base[0])]
    rows = spark.createDataFrame(texts, "doc_id BIGINT, text STRING")
    got = collections.defaultdict(list)
    found = bagminhash.near_duplicates(rows, per_band=per_band, bands_=bands).collect()
    for r in found:
        got[r["class_id"]].append(r["doc_id"])
        assert r["n_class"] >= 1
    assert sorted(map(sorted, got.values())) == [sorted(c) for c in brute_classes([(k, t or "") for k, t in texts])]
    assert sum(r["kept"] for r in found) == len(got) and all(k == min(v) for k, v in got.items())


def test_signatures_estimate_weighted_similarity():
    rng, shingler, values = np.random.default_rng(2), bagminhash.Shingles(1), []
    for _ in range(6):
        a, b = ([str(x) for x in rng.zipf(1.5, 200) % 40] for _ in range(2))
        sets = [bagminhash.multiset(shingler.of(t)) for t in (a, b)]
        times = [bagminhash.signatures(np.zeros(len(s[0]), int), s[0], s[1], 1, 4096)[0] for s in sets]
        values.append((times[0] == times[1]).mean() - bagminhash.similarity(*sets))
    assert abs(np.mean(values)) < 0.01


def test_fingerprints_follow_the_order_of_ids(odd, documents):
    texts = dict(pairs(documents))
    order = sorted(texts, reverse=True)
    rows = {r["doc_id"]: r for r in fingerprints.edited_likeness(documents).collect()}
    same = dict(map(tuple, fingerprints.fingerprints(documents).collect()))
    errors = []
    for own, following in zip(order, order[1:] + order[:1]):
        text, other = texts[own], texts[following]
        cut = len(text) // 3
        edited = text[:len(text) - cut] + other[:cut]
        assert rows[own]["n_chars"] == len(text) and rows[own]["fingerprint"] == same[own]
        assert rows[own]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = (collections.Counter(zip(t.split(), t.split()[1:])) for t in (text, edited))
        if a | b:
            errors.append(rows[own]["near_edited"] - (a & b).total() / (a | b).total())
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08
    assert fingerprints.edited_likeness(odd).count() == len(ODD)
    single = fingerprints.edited_likeness(documents.limit(1)).first()
    assert single["near_next"] == 1.0


def test_fingerprints_of_long_texts_estimate_jaccard(spark):
    sampler = fingerprints.Sampler()
    r, c, b = (np.concatenate(x) for x in zip(*([y.copy() for y in sampler.draws(np.arange(at, at + 90, dtype=np.uint64))] for at in range(0, 1800, 90))))
    for x in (r, c):
        assert abs(x.mean() - 2) < 0.02 and abs(x.var() - 2) < 0.05 and abs((x < 1).mean() - (1 - 2 / np.e)) < 0.01
    assert abs(b.mean() - 0.5) < 0.01 and abs(b.var() - 1 / 12) < 0.002 and 0 <= b.min() and b.max() < 1
    assert np.abs(np.corrcoef([r.ravel(), c.ravel(), b.ravel()]) - np.eye(3)).max() < 0.01
    rng, rows = np.random.default_rng(3), []
    for n in (20_000, 65_536, 200_000):
        for _ in range(2):
            rows.append((-len(rows), " ".join(map(str, rng.integers(0, 10 ** 9, n)))))
        # Repeated pairs have weights, and half of the text is shared with the one before.
        rows.append((-len(rows), rows[-1][1][:len(rows[-1][1]) // 2] + " " + " ".join(map(str, rng.integers(0, 150, n // 2)))))
    got = {r["doc_id"]: r for r in fingerprints.edited_likeness(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()}
    bags, errors = [], []
    for at, (key, text) in enumerate(rows):
        other = rows[(at + 1) % len(rows)][1]
        cut = len(text) // 3
        bags = [collections.Counter(zip(t.split(), t.split()[1:])) for t in (text, text[:len(text) - cut] + other[:cut], other)]
        for name, near in (("near_edited", bags[1]), ("near_next", bags[2])):
            true = (bags[0] & near).total() / (bags[0] | near).total()
            assert abs(got[key][name] - true) < (0.15 if true > 0.01 else 0.03)
            errors.append(got[key][name] - true)
    assert abs(np.mean(errors)) < 0.03
    # Fingerprints do not depend on what the memo holds.
    codes = sampler.codes(rows[0][1].split())
    assert (fingerprints.Sampler(memo=2).sample(codes) == sampler.sample(codes)).all() and (sampler.sample(codes) == sampler.sample(codes)).all()


PAGES = [(5, "u", "<p>x</p>"), (2, "u\nv", "<p>x</p>"), (2, None, "<p>x</p>"), (9, "w", None), (None, "n", ""), (4, "l", "é" * 300)]


def test_archives_round_trip(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame(PAGES, "page_id BIGINT, url STRING, html STRING").withColumn("digest", F.lit(1))
    got = warc.archived(rows).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    assert bag(r[:3] for r in got) == bag((k, len((t or "").encode()), digest(t)) for k, _, t in PAGES)
    assert bag((r["page_id"], r["record_type"], r["refers_to"]) for r in got) == bag([
        (2, "response", None), (2, "revisit", 2), (4, "response", None), (5, "revisit", 2), (9, "response", None), (None, "revisit", 9)])
    assert {r["record_type"] for r in warc.archived(rows, least=1000).collect()} == {"response"}
    assert warc.archived(rows.filter("false")).count() == 0
    monkeypatch.setattr(warc, "SEGMENT", 100)
    path = str(tmp_path / "archives")
    warc.write_archives(rows, path)
    assert sorted(r["payload"].decode() for r in warc.read_archives(spark, path).filter("record_type = 'response'").collect()) == \
        sorted(["<p>x</p>", "", "é" * 300])
    for file in (tmp_path / "archives").glob("part-*"):
        assert not file.stat().st_size or gzip.decompress(file.read_bytes()).startswith(b"WARC/1.1")


def test_broken_archives_are_refused():
    row = {"page_id": 1, "url": "u", "payload": b"abc", "row_id": 3, "first_row": 3, "first_page": None, "digest": warc.sha1(b"abc")}
    whole = b"".join(warc.members(row))
    assert [r["payload"] for r in warc.records(whole + whole)] == [b"abc"] * 2
    with pytest.raises(ValueError):
        list(warc.records(whole[:-9]))
    with pytest.raises(ValueError, match="digest"):
        list(warc.records(b"".join(warc.members({**row, "digest": warc.sha1(b"x")}))))


def test_quality_facts_equal_brute_force(odd, documents):
    for rows in (odd, documents):
        want = []
        for key, text in pairs(rows):
            words = re.findall("[^\\x20\\x09-\\x0D]+", text)
            lines = [x for x in text.split("\n") if re.search("[^\\x20\\x09-\\x0D]", x)]
            windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
            often = collections.Counter(windows)
            hit = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 3)}
            failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
            want.append((key, len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)),
                         sum(x in lines[:i] for i, x in enumerate(lines)), len(hit), failed))
        got = compression.quality_facts(rows)
        assert bag(got.drop("kept", "ratio", "odd_share").collect()) == bag(want)
        assert got.filter("base_failed and kept").count() == 0


def test_compression_bands():
    ratios, rng = compression.Ratios(compression.Bands()), np.random.default_rng(4)
    prose = " ".join("".join(rng.choice(list("etaoinshr"), rng.integers(2, 9))) for _ in range(4000))
    noise = base64.b85encode(rng.bytes(20_000))
    assert ratios.verdict(prose.encode())[0] and not ratios.verdict(b"again and " * 900)[0] and not ratios.verdict(noise)[0]
    assert not ratios.verdict(prose.encode()[:9000] + b"For " * 4000)[0] and ratios.verdict(b"short")[0]


def test_bands_from_all_documents_reject_beyond_the_base_rules(spark):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(3, 9))) for _ in range(2000)]
    clean = [" ".join(rng.choice(words, rng.integers(150, 700))) for _ in range(500)]
    junk = [" | ".join("#" + x + "$" for x in rng.choice(words, rng.integers(150, 400))) for _ in range(12)]
    half = [t[:len(t) // 2] + base64.b85encode(rng.bytes(800)).decode() + " " + t[len(t) // 2:] for t in clean[:6]]
    rows = [*clean, *junk, *half, *[clean[7]] * 900]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id BIGINT, text STRING").repartition(4)
    bands = compression.measured(docs)
    assert bands == compression.measured(docs.repartition(7)) == compression.measured(docs.dropDuplicates(["text"]))
    # The limits by hand: quartiles of the ratios in each run of length classes that holds 200 texts.
    ratios, by_class = compression.Ratios(compression.Bands()), collections.defaultdict(list)
    different = [t.encode() for t in set(rows) if not compression.base_facts(t)[0].base_failed]
    for raw in different:
        e = len(raw).bit_length() - 1
        by_class[4 * e + len(raw) * 4 // 2 ** e - 4].append(round(1000 * ratios.ratio(raw)))
    first, pool, want = None, [], []
    for number in sorted(by_class):
        first, pool = number if first is None else first, pool + by_class[number]
        if len(pool) >= 200:
            want, first, pool = [*want, [first, pool]], None, []
    want[-1][1] += pool
    for (number, low, high), (first, held) in zip(bands.whole, want, strict=True):
        a, b = (np.quantile(held, q, method="inverted_cdf") / 1000 for q in (0.25, 0.75))
        assert number == first and np.allclose((low, high), (a - max(1.5 * (b - a), 0.02), b + max(1.5 * (b - a), 0.02)))
    facts = {r["doc_id"]: r for r in compression.quality_facts(docs).collect()}
    assert not any(facts[i]["base_failed"] for i in range(500, 518))
    assert not any(facts[i]["kept"] for i in range(500, 512)) and sum(facts[i]["kept"] for i in range(500)) > 480
    assert all(facts[i]["kept"] for i in range(518, 1418)) == facts[7]["kept"]
    assert sorted(r["doc_id"] for r in compression.keep_quality(docs).collect()) == sorted(i for i, r in facts.items() if r["kept"])


def kept_bytes(rows, length):
    """Texts without the characters all of whose bytes are covered by a string that starts at two places."""
    raws = [t.encode() for _, t in rows]
    starts = collections.Counter(raw[i:i + length] for raw in raws for i in range(len(raw) - length + 1))
    for raw in raws:
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if starts[raw[i:i + length]] > 1:
                gone[i:i + length] = True
        text, at = [], 0
        for c in raw.decode():
            if not gone[at:at + len(c.encode())].all():
                text.append(c)
            at += len(c.encode())
        yield "".join(text)


def test_pipeline_equals_brute_force(spark, tmp_path):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    rng = np.random.default_rng(8)
    rows = [r for r in given.filter("text is not null").orderBy("doc_id").limit(300).collect() if r["text"].isascii()]
    long = [r for r in rows if 150 < len(r["text"].split()) < 1500][:40]
    passage = "".join(rng.choice(list("abcdefghijklmnop   "), 400))
    made, top = [r.asDict() for r in rows], 10_000_000
    planted = collections.defaultdict(list)
    for i, r in enumerate(long):
        words = r["text"].split(" ")
        edited = " ".join([*words[:70], "edited", *words[71:]])
        for kind, text in (("exact", r["text"]), ("near", edited), ("junk", "ab " * 400 + str(i)), ("numbers", " ".join(map(str, rng.integers(0, 10**6, 90)))),
                           ("passage", " ".join(rng.choice(words, 90)) + "\n" + passage + "\n" + " ".join(rng.choice(words, 90)))):
            top += 1
            planted[kind].append(top)
            made.append({**r.asDict(), "doc_id": top, "text": text, "n_chars": len(text)})
    spark.createDataFrame(made, given.schema).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = pairs(docs) if name != "quality_rules" else list(texts.items())
        docs = stage(spark, docs, str(tmp_path)).cache()
        got = collections.Counter(r["doc_id"] for r in docs.select("doc_id").collect())
        if name == "quality_rules":
            failed = {k for k, t in before if len(t.split()) < 50}
            assert not failed & set(got) and not set(planted["junk"]) & set(got) and got.total() > 0.75 * (len(before) - len(failed) - len(long))
        elif name == "language_id":
            assert not set(planted["numbers"]) & set(got) and {k for k, t in before if re.search("[a-z]", t)} - set(got) == set()
        elif name == "near_dedup":
            # Brute force: components of documents that are alike in 0.8 of their shingles, the smallest id of each.
            assert set(got) == {min(c) for c in brute_classes(before)}
            assert not (set(planted["exact"]) | set(planted["near"])) & set(got)
        elif name == "suffix_dedup":
            assert bag(pairs(docs)) == bag(zip([k for k, _ in before], kept_bytes(before, 200)))
            assert not any(passage in t for _, t in pairs(docs))
        else:
            library, want = Tokenizer.from_file(WORDS), []
            for key, text in before:
                ids = np.array(library.encode(text, add_special_tokens=False).ids + [0], "<u4")
                want += [(key, i // 2048, zlib.crc32(ids[i:i + 2048].tobytes())) for i in range(0, len(ids), 2048)]
            assert bag(docs.select("doc_id", "piece", "ids_crc32").collect()) == bag(want)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    last = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert bag(whole.select(*last).collect()) == bag(docs.select(*last).collect())


def test_pipeline_of_odd_texts(spark, odd, documents):
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF).cache()
        assert docs.columns == documents.columns and docs.count() > 0.8 * before.count()
    rows = odd
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, odd.filter("false"), SF)
        assert empty.count() == 0
        rows = stage(spark, rows, SF)
        if name != "best_fit_packing":
            assert rows.columns == odd.columns
    # Only the long text has fifty words that do not repeat.
    assert {r["doc_id"] for r in rows.collect()} <= {4}


def test_helper_columns_do_not_clash(spark, odd):
    # Columns that are called like the operators' own ones come back as they were.
    named = odd.select("*", F.concat(F.lit("r"), F.col("doc_id")).alias("__row"), F.lit("c").alias("__Cut"), F.lit(5).alias("class"),
                       F.lit(6).alias("first"), F.lit(7).alias("___row"))
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.repeats):
        plain = [c for c in odd.columns]
        got = stage(spark, named, SF)
        assert got.columns == named.columns
        assert bag(got.select(*plain).collect()) == bag(stage(spark, odd, SF).collect())
        assert got.filter("not (__row <=> concat('r', doc_id)) or __Cut != 'c' or class != 5 or first != 6 or ___row != 7").count() == 0


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
