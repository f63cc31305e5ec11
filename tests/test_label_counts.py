"""Labels counted by material are those of the boards."""

import random
from collections import Counter

from pyspark.sql import functions as F

from corpusloom.functions import bitboards as BB
from corpusloom.operators import material


def test_labels_are_counted_by_material_without_a_join(spark):
    rng = random.Random(6)
    men = ["Kk" + "".join(rng.choice("QRBNPqrbnp") for _ in range(rng.choice((1, 2, 3, 4)))) for _ in range(150)]
    boards = ["".join(rng.sample(m.ljust(64, "."), 64)) for m in men]
    df = spark.createDataFrame(list(enumerate(boards)), "k int, board string")
    bits = BB.of_pieces(df.select("k", F.posexplode(F.split("board", "")).alias("at", "p")).where("p not in ('.', '')"), "k", F.col("at") + 1, F.col("p"))
    counted = material.label_counts(bits, of=material.material_of_bits())
    assert "Join" not in counted._jdf.queryExecution().executedPlan().toString()
    want = Counter(x for r in material.judged(df).collect() for x in r.labels)
    assert want and {r.label: r.n for r in counted.collect()} == want
