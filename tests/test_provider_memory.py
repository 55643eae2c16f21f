"""What a task's provider holds."""

from pyspark.sql import functions as F

from brindle.sources import providers


def test_a_provider_keeps_no_prompts(spark):
    kept = []

    class Watched(providers.EchoGenerator):
        def chat(self, messages):
            out = super().chat(messages)
            kept.append(len(self.asked))
            return f"{max(kept)}"

    prompts = spark.range(300).coalesce(1).select(F.col("id").alias("qid"), F.lit("s").alias("system"), F.repeat(F.lit("x"), 4000).alias("user"))
    got = providers.generate(prompts, Watched).collect()
    assert len(got) == 300 and {r["answer"] for r in got} == {"1"} and all(r["error"] is None for r in got)
