"""Every stage of the pipeline against brute force over what the stage before kept."""

import random
import re
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from evidence_spark import session
from evidence_spark.llm import quality
from evidence_spark.session import scratch_table
from test_line_dedup import key
from test_near_copies import grams, plain_classes, plain_links

SF = "/root/testdata/sf0.001"


def without_passages(texts, words=50):
    """Plain counting of all sequences of words; a removed run goes with the white space after it."""
    found = [[(m.start(), m[0]) for m in re.finditer("[^\x20\x09-\x0d]+", t or "")] for t in texts]
    count = Counter(tuple(w for _, w in f[i : i + words]) for f in found for i in range(len(f) - words + 1))
    out = []
    for t, f in zip(texts, found):
        gone = set()
        for i in range(len(f) - words + 1):
            if count[tuple(w for _, w in f[i : i + words])] > 1:
                gone.update(range(i, i + words))
        edges = [s for s, _ in f] + [len(t or "")]
        kept = (t or "")[: edges[0]] + "".join(t[edges[i] : edges[i + 1]] for i in range(len(f)) if i not in gone)
        out.append(kept if t is not None else None)
    return out


def test_stages_agree_with_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    before = [tuple(r) for r in docs.collect()]
    scores = {r["doc_id"]: r["predicted"] for r in quality.classify(docs, labels).collect()}
    for name, stage in corpus_pipeline.STAGES:
        result = scratch_table(stage(spark, docs, SF), "test-stage")
        rows = [tuple(r) for r in result.collect()]
        if name == "quality classifier":
            want = [r for r in before if scores[r[0]]]
            assert 0 < len(want) < len(before)
        elif name == "line dedup":
            found = Counter(k for r in before for k in {key(x) for x in r[1].split("\n")} if k)
            texts = ["\n".join(x for x in r[1].split("\n") if not (key(x) and found[key(x)] >= 10)) for r in before]
            want = [(r[0], t, r[2], r[3], len(t)) for r, t in zip(before, texts)]
        elif name == "SimHash near-dedup":
            truth = plain_classes([r[1] for r in before], plain_links([r[1] for r in before]))
            least = {}
            for r in before:
                least[truth[grams(r[1])]] = min(r[0], least.get(truth[grams(r[1])], r[0]))
            want = [r for r in before if r[0] in set(least.values())]
        elif name == "suffix-array dedup":
            want = [(r[0], t, r[2], r[3], len(t)) for r, t in zip(before, without_passages([r[1] for r in before]))]
        else:
            model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            tokens = Counter()
            for r in result.collect():
                tokens[r["doc_id"]] += r["length"]
            assert tokens == {r[0]: len(model.encode(r[1], add_special_tokens=False).ids) + 1 for r in before}
            used = result.select("sequence_id").distinct().count()
            assert used <= -(-sum(tokens.values()) // 2048) * 1.05 + 1
            continue
        assert result.columns == docs.columns and sorted(rows) == sorted(want), name
        docs, before = result, rows


def test_planted_passages_of_fifty_words_go(spark):
    r = random.Random(8)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(n))
    passages = [prose(r.randint(50, 60)) for _ in range(30)]
    rows = [(i, prose(r.randint(0, 150)) + " " + r.choice([" ", "\n"]).join(passages[i % 30].split(" ")) + " " + prose(r.randint(20, 150)), "en", "s", 1) for i in range(75)]
    rows += [(100 + i, prose(200), "en", "s", 1) for i in range(20)] + [(200, None, None, None, None), (201, "", "en", "s", 0), (202, "a " * 70, "en", "s", 1), (None, "b " * 49, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    done = {x["doc_id"]: x["text"] for x in corpus_pipeline.suffix_stage(spark, docs, SF).collect()}
    assert done == dict(zip([x[0] for x in rows], without_passages([x[1] for x in rows])))
    middle = [" ".join(re.split(r"\s+", p)[10:40]) for p in passages]
    assert all(middle[i % 30] in " ".join(rows[i][1].split()) and middle[i % 30] not in " ".join(done[i].split()) for i in range(75))
    assert all(done[100 + i] == rows[75 + i][1] for i in range(20))
    assert corpus_pipeline.suffix_stage(spark, docs.limit(0), SF).count() == 0


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_tables_of_a_stage_are_removed_after_it(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "scratch_root", lambda spark: str(tmp_path))
    packed = corpus_pipeline.run(spark, SF)
    left = sorted(p.name[:-33] for p in (tmp_path / "evidence_spark").iterdir())
    assert left == sorted([*(name.replace(" ", "-") for name, _ in corpus_pipeline.STAGES[:-1]), "packing-lengths", "packing-pieces"])
    assert packed.agg({"length": "sum"}).first()[0] > 0
