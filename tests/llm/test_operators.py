"""Operators against brute force, and their defined results on odd rows."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from shelfwise.llm import queries
from shelfwise.llm.common import stored
from shelfwise.llm.decontamination import WindowSet, contamination, words
from shelfwise.llm.html_extraction import Field, Paths, blocks, features, main_text
from shelfwise.llm.html_pages import labelled_pages
from shelfwise.llm.language import UNKNOWN, identify
from shelfwise.llm import packing
from shelfwise.llm.packing import Bins, Encoder, cut, pack, packed
from shelfwise.llm.pii import BoostedTrees, find, redact
from shelfwise.llm.quality import VoteModel, measures, quality
from shelfwise.llm.sharding import allot, capacities, shard_rows
from shelfwise.llm.simhash import components, deduplicated, fingerprint, masks, near_duplicates, near_edges
from shelfwise.llm.toxicity import fit, toxicity

SMALL = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, score double, fp long, t string"
LONG = " ".join(f"word{i % 977} tail{i % 13}" for i in range(40_000))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, repeated and very long texts, ties, and columns named like the operators' own."""
    text = ["plain words of a short text", None, "", "  \n\t ", LONG, "plain words of a short text", "mail me at ann@example.org or +1 (555) 123-4567"]
    rows = [(k if k != 3 else None, t, "en" if k % 2 else None, "s", len(t or ""), "r", 0.5, 1, "x") for k, t in enumerate(text)]
    return spark.createDataFrame([*rows, rows[0], rows[0]], COLUMNS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, k % 2) for k in range(40)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def marked(spark):
    rows = [(k, f"some common words here {'vile scum' if k % 2 else 'kind friend'} number {k}") for k in range(40)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_toxicity(spark, odd, none, labels, marked):
    found = {r["doc_id"]: r for r in toxicity(marked, labels).collect()}
    assert all(found[k]["predicted"] == k % 2 for k in range(40))
    both = toxicity(marked.unionByName(odd.select("doc_id", "text")), labels).collect()
    assert len(both) == 49 and all(0 <= r["score"] <= 1 for r in both)
    assert toxicity(odd, labels.limit(0)).where("predicted = 0").select("row.*").columns == odd.columns
    assert toxicity(none, labels).count() == 0


def test_toxicity_of_scattered_words(spark):
    """A few words on one stem, scattered over clean text, are found in documents that the models have not seen."""
    rng = np.random.default_rng(5)
    parts = np.array(["ba", "che", "dor", "en", "fi", "gral", "ho", "in"])
    word = lambda: "".join(rng.choice(parts, rng.integers(1, 4)))
    rows = []
    for k in range(600):
        text = [word() for _ in range(60)]
        if k % 4 == 0:
            for at in rng.choice(60, 4, replace=False):
                text[at] = "grachen" + word()
        rows.append((k, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = toxicity(docs, spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(600)], "doc_id long, toxic int")).where("held_out").collect()
    assert sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in found) > 0.95 * len(found) > 100


def test_toxicity_keeps_every_ngram_of_its_sample(spark):
    """Rare spellings late in the alphabet are in the models however many n-grams the sample has."""
    rng = np.random.default_rng(6)
    spelled = ["".join(map(chr, w)) for w in rng.integers(97, 123, (150_000, 9))]
    rows = [(k, " ".join(spelled[k::40]) + (f" zz{'yxwvutsrqp'[k // 4]}zzyzy" if k % 4 == 0 else "")) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    models, _ = fit(docs, spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(40)], "doc_id long, toxic int"))
    counted = [t for k, t in rows if zlib.crc32(str(k).encode()) % 4 not in (2, 3)]
    grams = {"\x02" * 8 + w + "\x03" for t in counted for w in t.split()}
    grams = {g[i : i + 9] for g in grams for i in range(len(g) - 8)}
    assert len(grams) > 450_000 and models.value.ratio.keys() == grams


def test_language(spark, odd, none):
    rows = [(k, ("der die und nicht ein " if k % 2 else "the and of with that ") * 3 + str(k), "de" if k % 2 else "en") for k in range(60)]
    found = identify(spark.createDataFrame([*rows, (61, None, "de"), (62, "12 345 !", "en")], "doc_id long, text string, lang string"))
    by = {r["doc_id"]: r for r in found.collect()}
    assert all(by[k]["lang_pred"] == ("de" if k % 2 else "en") and 0 <= by[k]["score"] <= 1 for k in range(60))
    assert by[61]["lang_pred"] == by[62]["lang_pred"] == UNKNOWN and by[61]["score"] == 0
    assert identify(odd).count() == 9 and identify(none).count() == 0


def _measured(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, covered = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if seen[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, odd, none):
    texts = ["a b c a b c\nx\nx\n y", "a b a b a b", "ünïcode *** w", "one\x0btwo\x0cthree\rfour", LONG]
    rows = measures(odd.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string")))
    found = Counter(tuple(r)[1:6] for r in rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    assert found == Counter(_measured(t) for t in [*texts, *(r["text"] for r in odd.collect())])
    verdict = quality(odd)
    assert verdict.count() == 9 and verdict.where("base_failed AND kept").count() == 0 and quality(none).count() == 0


def test_votes_find_the_better_rule():
    counts = {(1, 1, 0): 800, (1, 0, 1): 60, (-1, -1, 0): 90, (-1, 1, 0): 20, (0, -1, -1): 30}
    model = VoteModel(["a", "b", "c"], counts)
    assert model.posterior((1, 1, 0)) > 0.9 > 0.1 > model.posterior((-1, -1, 0))
    assert all(0.5 <= x <= 1 for x in model.accuracy().values())


def test_extraction(spark, none):
    field, paths, right, n = Field().fit(labelled_pages(300)), Paths(), 0, 0
    for page in labelled_pages(80, 99):
        found = blocks(page, paths)
        got = field.viterbi(field.emissions(features(found)))
        right += sum(bool(y) == ("*main" in b[0]) for y, b in zip(got, found))
        n += len(found)
    assert right > 0.98 * n
    page = ('<html><title>t</title><nav><a href="/">Home</a></nav><article><h1>A &amp; B</h1><p>One  <b>two</b>\n three.'
            '<p>Four &lt;five&gt;.</article><script>var x = "<p>no</p>"</script><footer>&copy; us</footer>')
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (1, "u", page), (4, "w", "<p><" * 3000)], "page_id long, url string, html string")
    found = main_text(rows.withColumn("text", F.lit("clash"))).collect()
    assert [r["text"] for r in found if r["page_id"] == 1] == ["A & B One two three. Four <five>."] * 2
    assert all(r["n_chars"] == len(r["text"]) for r in found) and {r["page_id"] for r in found if not r["text"]} >= {2, 3}


def test_blocks_after_left_out_elements():
    """Self-closed and unclosed elements, and longer names, leave the rest of the page in place."""
    for page, want in {
        '<p>One <svg class="i"/> two.</p><p>Three.</p>': ["One two.", "Three."],
        "<p>One <svg><g><title>x</title><text>no</text></g></svg> two.</p><p>Three.</p>": ["One two.", "Three."],
        "<div><p>One <svg><path d='a'> no</p><p>Three.</p></div>": ["One", "Three."],
        "<select-menu x=1></select-menu><p>Three.</p>": ["Three."],
        "<template-card><p>One</p></template-card><title-bar>Two</title-bar><style-guide/><p>Three.</p>": ["One", "Two", "Three."],
        "<noscript><div><a href=x>no</a></div></noscript><select><option>no<option>no</select><p>Three.</p>": ["Three."],
        "<title>no</title><script>if (a<b) no('<p>')</script><p>Three.</p><style>no": ["Three."],
    }.items():
        found = blocks(page, Paths())
        assert [b[2] for b in found] == want and not any(b[3] for b in found)


def test_contamination(spark, odd, none):
    item = " ".join(f"b{i}" for i in range(20))
    tests = spark.createDataFrame([(1, item), (2, "tiny Item"), (3, None), (None, item), (2, "tiny Item")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x, " + item.upper() + " y"), (2, "a tiny-item b"), (3, " ".join(item.split()[:12])), (4, None)], "doc_id long, text string")
    for most in (200_000, 3):
        by = {r["doc_id"]: r for r in contamination(docs, tests, max_windows=most).collect()}
        assert [(by[k]["n_words"], by[k]["n_hit"], by[k]["items"], by[k]["contaminated"]) for k in (1, 2, 3, 4)] == [
            (22, 20, ["1"], True), (4, 2, ["2"], True), (12, 0, [], False), (0, 0, [], False)]
    assert contamination(odd, tests).count() == 9 and contamination(odd, tests.limit(0)).where("contaminated").count() == 0
    assert contamination(none, tests).select("row.*").columns == none.columns
    assert words("Ünï-code 9Z".encode()) == ["Ünï".encode(), b"code", b"9z"] and not WindowSet([]).scan([b"a"])[0]


def _linked(prints, distance=4):
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (a ^ b).bit_count() <= distance:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {p: root(p) for p in prints}


def test_near_edges_lose_no_link(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 60, dtype=np.int64)
    prints = {int(x) for x in base}
    for x in base:
        for _ in range(6):
            for bit in rng.integers(0, 63, rng.integers(1, 7)):
                x = x ^ (1 << int(bit))
            prints.add(int(x))
    want = _linked(prints)
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    for node, block in ((256, 4096), (1, 4096), (256, 16)):
        stars = {r["u"]: r["v"] for r in components(near_edges(frame, node=node, block=block)).collect()}
        assert {p: stars.get(p, p) for p in prints} == want
    for n in (10, 10**6, 10**12):
        assert all(any((x & m) == 0 for m in masks(n)) for x in (0, 0b1111, 1 << 63 | 1 << 40 | 1 << 20 | 1))


def test_simhash(spark, odd, none):
    def plain(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        runs = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    for text in ("one two three four five six one two", "a b", "", None, "A b C d"):
        assert fingerprint((text or "").encode()) == plain(text)
    rows = near_duplicates(odd).collect()
    assert len(rows) == 9 and all(len(r["fingerprint"]) == 16 for r in rows)
    assert {r["component_id"] for r in rows if r["fingerprint"] == "0" * 16} == {1}
    kept = deduplicated(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 4, 6]
    assert near_duplicates(none).count() == 0 and deduplicated(none).count() == 0


def test_packing(spark, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ours = Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for text in ("a b", " lead", "two  spaces", "tab\t and\n new  line \n", "it's we'll 12 34", "trail ", "ümlaut  x", "\n \n", "", "a <|endoftext|> b", "x<|endoftext|>", "<|endoftext|>  y"):
        assert list(np.frombuffer(ours.ids(text), "<u4")) == exact.encode(text, add_special_tokens=False).ids
    assert cut(1, 4) == [(0, 1)] and cut(4, 4) == [(0, 4)] and cut(9, 4) == [(0, 1), (1, 4), (5, 4)]
    rows = packed(odd).toPandas().sort_values(["sequence_id", "offset"])
    groups = rows.groupby("sequence_id").length
    assert (groups.cumsum() - rows.length == rows.offset).all() and groups.sum().max() <= 1024
    assert (rows.length[rows.piece > 0] == 1024).all() and len(rows[rows.piece == 0]) == 9
    assert packed(none).count() == 0


def test_bins_stay_bounded():
    bins, rng = Bins(1024, 4), np.random.default_rng(0)
    placed = [(*bins.place(int(n)), int(n)) for n in rng.integers(1, 1025, 3000)]
    assert bins.open <= 4
    filled = {}
    for bin_id, offset, n in placed:
        assert filled.get(bin_id, 0) == offset and offset + n <= 1024
        filled[bin_id] = offset + n


def test_bins_agree_with_a_search_of_all_bins():
    """Best fit by looking at every open bin: the fullest that still holds the piece; the fullest closes when too many are open."""
    rng = np.random.default_rng(1)
    for open_bins in (1, 3, 50):
        bins, free, fresh = Bins(64, open_bins), [], 0  # free: open bins as [space, number], in the order of opening
        for size in map(int, rng.integers(1, 65, 1500)):
            number, offset = bins.place(size)
            fitting = [b for b in free if b[0] >= size]
            if fitting:
                space = min(b[0] for b in fitting)
                mine = next(b for b in reversed(free) if b[0] == space and b[1] == number)  # of equally full ones any
                free.remove(mine)
            else:
                space, mine, fresh = 64, [64, fresh], fresh + 1
            assert (number, offset) == (mine[1], 64 - space)
            if space > size:
                if len(free) == open_bins:
                    least = min(b[0] for b in free)
                    closed = [b for b in free if b[0] == least]
                    held = {n for bin_ids in bins.by_free for n in bin_ids}
                    free.remove(next(b for b in closed if b[1] not in held))
                free.append([space - size, number])
        assert bins.made == fresh


def test_repeated_rows_are_parted(spark):
    """One row many times over is packed in several groups."""
    items = spark.range(4000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(700).cast("long").alias("length"), F.lit(5).cast("long").alias("ids_crc32"))
    rows = pack(items.repartition(4), group=500).toPandas()
    assert len(rows) == 4000 and rows.sequence_id.nunique() == 4000 and (rows.offset == 0).all()
    assert (rows.sequence_id // 2**40).nunique() == 8
    assert "_salt" not in rows


def test_encoder_forgets_the_older_half(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(packing, "MEMORY", 20)
    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    text = " ".join(f"w{k % 17} x{k}" for k in range(200))
    assert encoder.ids(text) == encoder.whole(text) and len(encoder) <= 10 and len(encoder.older) <= 10


def test_sharding(spark, odd, none):
    many = spark.range(3000).select(F.when(F.col("id") < 1000, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("té").alias("text"))
    for cell in (100_000, 50):
        rows = shard_rows(many, cell=cell).toPandas()
        assert len(rows) == 3000 and set(rows["size"]) == {4} and set(rows.text_crc32) == {zlib.crc32("té".encode())}
        slots = rows.groupby("shard").slot.apply(sorted)
        assert all(s == list(range(len(s))) for s in slots) and {len(s) for s in slots} == {187, 188}
    assert shard_rows(odd).count() == 9 and shard_rows(none).count() == 0
    runs = allot([5, 0, 9], [0, 1, 1], capacities(14, 2, 1.0))
    assert sum(r[2] - r[1] for r in runs) == 14 and max(sum(r[2] - r[1] for r in runs if r[3] == s) for s in (0, 1)) == 7


def test_pii(spark, odd, none):
    text = "ß x@y.z q 4111 1111 1111 1111 and 10.0.0.256 1.2.3.4 +1 (269) 555-3296"
    docs = spark.createDataFrame([(k, text if k < 50 else text + " 4024007103939509") for k in range(52)], "doc_id long, text string")
    by = {r["doc_id"]: r for r in find(docs).collect()}
    spans = lambda r, c: {(s["start"], s["end"], s["kind"]) for s in r[c]}
    at = {k: (text.index(s), text.index(s) + len(s)) for k, s in enumerate(("x@y.z", "1.2.3.4", "4111 1111 1111 1111", "+1 (269) 555-3296"))}
    assert spans(by[0], "base") == {(*at[k], k) for k in at}
    assert (*at[3], 3) not in spans(by[51], "base") and (*at[3], 3) in spans(by[51], "spans")
    assert spans(by[51], "base") <= spans(by[51], "spans")
    clean = {r["doc_id"]: r["text"] for r in redact(docs).collect()}
    assert clean[0] == "ß <EMAIL> q <CARD> and 10.0.0.256 <IP> <PHONE>"
    out = redact(odd)
    assert out.dtypes == odd.dtypes and out.where("text IS NULL").count() == 1 and out.where("text LIKE '%<EMAIL>%<PHONE>%'").count() == 1
    assert find(none).count() == 0 and redact(none).count() == 0
    digits = spark.createDataFrame([(1, "7" * 60_000 + " " + "a" * 60_000 + " " + "1.2.3.4 " * 3000)], "doc_id long, text string")
    assert find(digits).select(F.size("base")).first()[0] == 3000


def test_pii_adds_loose_forms_however_many(spark):
    """Forms that no base pattern matches are added also where they are frequent; what only looks alike is not."""
    loose = ["write to ann (at) example.org soon", "call 555-123-4567 today", "card 4222222222222 ."]
    firm = "write to bob@example.org or call +1 555 123 4567 with card 4111 1111 1111 1111 ."
    rows = [*enumerate([firm] * 100), *enumerate(loose * 60, 100), *enumerate(["part 1234 5678 9012 3456 fits"] * 20, 300)]
    by = {r["doc_id"]: r for r in find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, text in rows[100:280]:
        want = {"w": (9, 29, 0), "c": (5, 17, 3) if text[2] == "l" else (5, 18, 2)}[text[0]]
        assert [(s["start"], s["end"], s["kind"]) for s in by[k]["spans"]] == [want] and not by[k]["base"]
    assert not any(by[k]["spans"] for k in range(300, 320)) and all(len(by[k]["spans"]) == 3 for k in range(100))


def test_pii_threshold_judges_each_level():
    """A low level of few right spans is not carried by the many right ones above it."""
    row = lambda cue: (0, 10, 1, *[cue] * 5)
    counts = [(row(1), True, h, 1000) for h in (False, True)] + [(row(5), c, h, n) for h in (False, True) for c, n in ((True, 10), (False, 90))]
    model = BoostedTrees([(r, int(c), h, n) for r, c, h, n in counts])
    assert model.score(row(5)) < model.threshold[0] <= model.score(row(1))


def test_queries_and_pipeline(spark):
    assert sorted(queries.QUERIES) == sorted(f"op{k}_{n}" for k, n in enumerate(
        "lm_scoring toxicity quality html decontamination language simhash packing sharding pii vector_codes prefix_trie exact_dedup".split(), 1))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SMALL), name)
        kept[name] = docs
    assert all(kept[n].columns == spark.read.parquet(f"{SMALL}/documents.parquet").columns for n, _ in corpus_pipeline.STAGES[:-1])
    tests = [set(zip(*(w[k:] for k in range(13)))) for w in (words(r["text"].encode()) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect())]
    bad = 0
    for row in kept["near_duplicates"].collect():
        w = words(row["text"].encode())
        hit = {i + k for i in range(len(w) - 12) if any(tuple(w[i : i + 13]) in t for t in tests) for k in range(13)}
        bad += bool(hit) and 20 * len(hit) >= len(w)
    assert kept["near_duplicates"].count() - bad == kept["decontamination"].count() == kept["personal_data"].count()
    prints = {fingerprint((r["text"] or "").encode()) for r in kept["toxicity"].collect()}
    assert len(set(_linked(prints).values())) == kept["near_duplicates"].count()
    assert corpus_pipeline.run(spark, SMALL).where("piece = 0").count() == kept["personal_data"].count()
