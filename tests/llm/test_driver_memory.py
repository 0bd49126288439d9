"""What plans and stages leave in the driver."""

import os
import re
from pathlib import Path

from skein.llm.common import give_back_in_driver
from skein.llm.mixing import mix


def test_mix_plans_each_step_once(spark):
    rows = [(i, "w " * (i % 7), ("en", "de", None)[i % 3], f"src{i % 5}") for i in range(300)]
    df = mix(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"))
    assert df.count() == 300
    plan = df._jdf.queryExecution().executedPlan().toString()
    # With all steps in one plan these were 21 and some 40 (twice that where both the first and the final plan are shown).
    assert plan.count("BroadcastHashJoin") <= 4
    assert plan.count("Exchange") <= 8


def test_driver_gives_native_memory_back(spark):
    jvm = spark.sparkContext._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()
    held = lambda: int(re.search(r"\nPss_Anon:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text())[1]) if os.path.exists("/proc/self/smaps_rollup") else 0
    before = held()
    if give_back_in_driver(spark):  # else this JVM has no such command
        assert held() <= before + (64 << 10)
