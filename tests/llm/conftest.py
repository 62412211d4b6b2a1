import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, size string, class string, rank int"


def make_documents(seed=1, n=160):
    """Rows with copies, near copies, shared passages, junk, a hot source, a long text, nulls, and extra columns with clashing names."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("an", "er", "Tion", "ou", "re", "the", "é", "st")) for _ in range(r.randint(1, 4)))
    passage = " ".join(word() for _ in range(60))
    texts = []
    for i in range(n):
        k = i % 10
        if k == 0 and texts:
            texts.append(r.choice(texts))
        elif k == 1 and texts:
            w = r.choice([t for t in texts if t]).split(" ")
            w[r.randrange(len(w))] = word()
            texts.append(" ".join(w))
        elif k == 2:
            texts.append(passage + ".\n" + " ".join(word() for _ in range(r.randint(5, 120))))
        elif k == 3:
            texts.append("\n".join(" ".join(word() + r.choice(("$$$", "###", "!!")) for _ in range(12)) for _ in range(r.randint(2, 5))))
        elif k == 4:
            line = " ".join(word() for _ in range(9))
            texts.append("\n".join([line] * r.randint(2, 6)))
        else:
            texts.append(". ".join(" ".join(word() for _ in range(r.randint(3, 20))) for _ in range(r.randint(1, 12))) + ".")
    texts[:3] = [" ".join(word() for _ in range(6000)), "", "one two\tthree"]
    rows = [(i, t, r.choice(("en", "de", None)), "src0" if i % 3 == 0 else r.choice(("src1", "src2", "a", "Z", None)), len(t), i // 2, "x", "y", 1) for i, t in enumerate(texts)]
    rows += [(n, None, None, None, None, None, None, None, None), (n + 1, " \n\t ", "en", "src0", 4, 1, "x", "y", 1), (n + 2, "日本 語 テキスト 🙂 ' s t", "ja", "src9", 9, 1, "x", "y", 1)]
    return rows


@pytest.fixture(scope="session")
def documents():
    return make_documents()


@pytest.fixture(scope="session")
def fixture_dir(spark, documents, tmp_path_factory):
    """A folder of small tables laid out as the real ones are."""
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(documents, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 0 if i % 10 == 3 else 1, 0) for i in range(len(documents)) if i % 2 or i % 10 == 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path
