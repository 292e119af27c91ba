import os
import tempfile
import uuid

import numpy as np
import pandas as pd

from loanscope.operators import classifier
from loanscope.streaming.scoring import read_applications, start_scoring


def test_scoring_runs_on_a_stream(spark):
    pdf = pd.DataFrame({f: np.linspace(0, 1, 200) for f in classifier.FEATURES})
    pdf["is_default"] = (np.arange(200) % 4 == 0).astype(int)
    pdf["loan_id"] = [str(i) for i in range(200)]
    model = classifier.train_default_classifier(spark.createDataFrame(pdf), max_iter=3, max_depth=2).model

    tmp = tempfile.mkdtemp(prefix="loanscope-stream-")
    src, out = os.path.join(tmp, "in"), os.path.join(tmp, "out")
    apps = spark.createDataFrame(
        [(f"a{i}", 5000.0 + 100 * i, "36 months", 8.0 + i % 10, 200.0, "ABCDEFG"[i % 7], 50000.0 + i, 15.0,
          700.0 - i, 40.0, 8, "Verified" if i % 2 else "Not Verified", "RENT") for i in range(30)],
        "loan_id string, loan_amnt double, term string, int_rate double, installment double, grade string, "
        "annual_inc double, dti double, fico_range_low double, revol_util double, open_acc int, "
        "verification_status string, home_ownership string")
    apps.repartition(3).write.parquet(src)
    q = start_scoring(model, read_applications(spark, src, apps.schema, max_files_per_trigger=1), out,
                      name=f"test_scoring_{uuid.uuid4().hex[:8]}")  # a fixed name would resume
    q.awaitTermination(120)
    res = spark.read.parquet(out)
    assert res.count() == 30
    assert res.where("default_probability_pct < 0 OR default_probability_pct > 100").count() == 0
