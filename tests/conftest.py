import numpy as np
import pytest

from tallyforge.session import Tables, local_session

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(4, shuffle_partitions=4, memory="8g")


@pytest.fixture(scope="session")
def tables(spark):
    return Tables(spark, FOLDER)


@pytest.fixture(scope="session")
def blobs(spark):
    """Three well separated groups in the plane, with their true group."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    centres = np.array([[0.0, 0.0], [8.0, 0.0], [0.0, 8.0]])
    rows = []
    for i in range(150):
        x = centres[i % 3] + rng.normal(scale=0.4, size=2)
        rows.append((i, i % 3, [float(v) for v in x]))
    df = spark.createDataFrame(rows, "key long, truth int, x array<double>")
    return df.withColumn("features", array_to_vector(F.col("x"))).cache()


@pytest.fixture(scope="session")
def signal(spark):
    """Rows whose class and value follow from the features, split into train and test."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    rng = np.random.default_rng(42)
    x = rng.normal(size=(500, 5))
    label = (x[:, 0] + 0.6 * x[:, 1] > 0).astype(float)
    value = 2.4 * x[:, 0] - 1.1 * x[:, 3] + 0.3 * x[:, 4]
    rows = [(i, float(label[i]), float(value[i]), [float(v) for v in x[i]]) for i in range(500)]
    df = spark.createDataFrame(rows, "key long, label double, value double, x array<double>")
    df = df.withColumn("features", array_to_vector(F.col("x"))).cache()
    return df.filter("key < 400"), df.filter("key >= 400")
