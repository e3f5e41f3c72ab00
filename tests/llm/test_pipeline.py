"""The pipeline against a plain version that goes through the documents one by one."""

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import langid, pii, simhash, toxicity
from millrace.session import table
from tests.llm.test_tokens import BYTE, check_packing


def plain_near(documents):
    """Documents of which no near copy with a smaller id is reachable, by the sets of five-word shingles of all pairs."""
    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)}

    sets = {i: shingles(t) for i, t in documents}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(i, t) for i, t in documents if find(i) == i]


def test_pipeline_equals_the_plain_version(spark, data):
    documents = table(spark, data, "documents")
    profiles = langid.fit(documents)
    docs = [(r["doc_id"], r["text"]) for r in documents.collect()]
    docs = [(i, t) for i, t in docs if profiles.predict(t)[0] != langid.UNKNOWN]
    scorer = toxicity.fit(documents, table(spark, data, "labels"))
    docs = [(i, t) for i, t in docs if scorer.score(t) < 0.5]
    docs = plain_near(docs)
    field = pii.fit(spark.createDataFrame(docs, "doc_id long, text string"))
    docs = [(i, t if t is None else pii.redacted(t, pii.find([t], field)[0][1])) for i, t in docs]
    got = corpus_pipeline.run(spark, data).collect()
    check_packing(docs, got)
    assert {r["doc_id"] for r in got} == {i for i, _ in docs}
    ids = Tokenizer.from_file(BYTE)
    assert public_tokenizers.path("byte_bpe_50k.json") == BYTE
    assert sum(r["length"] for r in got) == sum(len(ids.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in docs)


def test_pipeline_cases(odd, empty, spark, data):
    for docs, most in ((odd, 11), (empty, 0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, data)
            assert after.columns == docs.columns and after.count() <= most
        assert (corpus_pipeline.STAGES[-1][1](spark, docs, data).count() > 0) == (most > 0)


def test_near_dedup_takes_any_column_names(spark):
    """Columns called row, node and set are data; rows that differ only in which column is null are two rows."""
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, 10, "n", 3), (2, text, 11, "m", 4), (3, "all other words than those of the first text here", 12, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, node string, `set` int")
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == [rows[0], rows[2]]
    odd = spark.createDataFrame([(None, "a", None), (None, None, "a"), ("a", None, None), (None, "a", None)], "text string, x string, _row0 string").selectExpr("7L AS doc_id", "*")
    assert odd.select(simhash._identity(odd)).distinct().count() == 3
    assert sorted(map(repr, simhash.keep_first(odd).collect())) == sorted(map(repr, odd.where("text = 'a' OR x = 'a'").dropDuplicates().collect()))


def test_sets_that_share_a_node_by_chance_stay_apart(spark):
    layout = simhash.Layout.of(10)
    columns = ", ".join(["doc_id long", "row binary", "node long", "check long", "n long", *[f"{x} long" for x in layout.names]])
    made = [(i, bytes([i]), node, check, 5, *[check] * len(layout.names)) for i, (node, check) in enumerate([(1, 10), (1, 10), (1, 20), (2, 30)])]
    described, each = simhash._distinct(spark.createDataFrame(made, columns), layout)
    nodes = {r["doc_id"]: r["node"] for r in described.collect()}
    assert nodes[0] == nodes[1] == 1 and nodes[2] not in (1, 2) and nodes[3] == 2 and each.count() == 3
    assert {r["node"]: r[layout.names[0]] for r in each.collect()} == {1: 10, nodes[2]: 20, 2: 30}


def test_stages_find_text_by_any_case(spark, data):
    docs = table(spark, data, "documents").withColumnRenamed("text", "Text").limit(30)
    more = docs.union(docs.limit(1).selectExpr("-1L", "'write to bob@mail.com now'", "lang", "source", "n_chars"))
    cleaned = pii.redact(more, pii.fit(more))
    assert cleaned.where("doc_id = -1").first()["Text"] == "write to [EMAIL] now" and cleaned.columns == docs.columns
    assert langid.keep_identified(docs, langid.fit(docs)).count() > 0
    scorer = toxicity.Scorer({}, 9.0)
    assert toxicity.keep_clean(docs, scorer).count() == 0
