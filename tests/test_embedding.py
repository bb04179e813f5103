"""Gradients by differences, and training on words that decide."""

import numpy as np
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from millrace.operators import embedding


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(3)
    weights = embedding.first_weights(12, width=3, units=4)
    weights.hidden[-1] = rng.normal(size=4) * 0.1
    codes, labels = rng.integers(0, 9, (7, 5)), rng.integers(0, 2, 7).astype(float)
    loss, met, parts = embedding.gradients(weights, codes, labels)
    assert met.tolist() == sorted(set(codes.reshape(-1).tolist()))
    whole = np.zeros_like(weights.embedding)
    whole[met] = parts[0]
    for table, slope in zip(weights.tables(), [whole, *parts[1:]], strict=True):
        for at in np.ndindex(*table.shape):
            old = table[at]
            table[at] = old + 1e-6
            up = embedding.gradients(weights, codes, labels)[0]
            table[at] = old - 1e-6
            down = embedding.gradients(weights, codes, labels)[0]
            table[at] = old
            assert abs((up - down) / 2e-6 - slope[at]) < 1e-5
    assert loss > 0


def test_gradients_of_tasks_add_up(spark):
    rng = np.random.default_rng(5)
    weights = embedding.first_weights(20, width=4, units=3)
    codes, labels = rng.integers(0, 20, (600, 6)), rng.integers(0, 2, 600).astype(float)
    rows = spark.createDataFrame([(c.astype(float).tolist(), float(y)) for c, y in zip(codes, labels, strict=True)], "codes array<float>, label double")
    found = embedding._summed(rows.repartition(5), weights, "codes", "label").set_index("slot")
    loss, met, parts = embedding.gradients(weights, codes, labels)
    assert found.loc[-1].to_numpy()[0] == 600 and abs(found.loc[-1].to_numpy()[1] - loss) < 1e-8
    np.testing.assert_allclose(found.loc[met].to_numpy()[:, :4], parts[0], atol=1e-10)
    np.testing.assert_allclose(found.loc[range(20, 25)].to_numpy()[:, :3], parts[1], atol=1e-10)


def test_words_that_decide_are_learned(spark):
    """Codes 5 and 6 stand for the label; null rows are left out, and no rows leave the first weights."""
    rng = np.random.default_rng(7)
    data = []
    for i in range(400):
        label = int(rng.integers(0, 2))
        codes = rng.integers(7, 30, 12)
        codes[rng.integers(0, 12)] = 5 if label else 6
        data.append((i, codes.astype(float).tolist(), float(label)))
    data += [(900, None, 1.0), (901, [7.0] * 12, None)]
    rows = spark.createDataFrame(data, "id long, codes array<float>, label double")
    weights = embedding.train(rows.where("id % 4 <> 0"), F.col("id") % 2, 2, 30, epochs=15)
    rated = embedding.rate_texts(rows.where("id % 4 = 0 AND id < 900"), weights, ["id", "label"])
    assert rated.columns == ["id", "label", "rating"] and rated.where("rating BETWEEN 0 AND 1").count() == 100
    assert BinaryClassificationEvaluator(rawPredictionCol="rating", labelCol="label").evaluate(rated) > 0.95
    empty = embedding.train(rows.limit(0), F.col("id") % 2, 2, 30, epochs=1)
    assert np.array_equal(empty.embedding, embedding.first_weights(30).embedding)
    assert embedding.rate_texts(rows.limit(0), weights, ["id"]).collect() == []
