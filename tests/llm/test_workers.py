"""Workers need no copy of the package: a run from another folder, with workers that cannot import it."""

import os
import subprocess
import sys
import textwrap
from pathlib import Path

REPO = Path(__file__).resolve().parents[2]


def test_operators_and_stages_run_where_workers_lack_the_package(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {str(REPO)!r})  # the driver only
        import random
        from plumbline.session import build_session
        spark = build_session("away", "local[4]", **{{
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.checkpoint.dir": {str(tmp_path / "shared")!r}}})
        spark.sparkContext.setLogLevel("ERROR")

        def absent(batches):
            try:
                import plumbline
                raise SystemExit("the worker sees the package")
            except ModuleNotFoundError:
                yield from batches

        assert spark.range(4).mapInArrow(absent, "id long").count() == 4
        rng = random.Random(1)
        words = "the of and to in that which thing other would der die und ein nicht mit".split()
        rows = [(i, " ".join(rng.choice(words) + rng.choice("abcdef") for _ in range(60)) + (" idiot scum" if i % 4 == 0 else ""),
                 "de" if i % 2 else "en", "s", 300) for i in range(120)]
        sf = {str(tmp_path / "sf")!r}
        write = lambda data, kinds, name: spark.createDataFrame(data, kinds).write.parquet(f"{{sf}}/{{name}}.parquet")
        write(rows, "doc_id long, text string, lang string, source string, n_chars long", "documents")
        write([(i, 1, int(i % 4 == 0)) for i in range(120)], "doc_id long, quality int, toxic int", "labels")
        write([(1, rows[7][1]), (2, "nothing of it here at all")], "item_id long, text string", "benchmark")
        write([(i, [rng.random() - 0.5 for _ in range(8)], i % 10) for i in range(200)], "vec_id long, embedding array<float>, label int", "embeddings")
        write([(i, f"http://a{{i}}.example.{{('net', 'org')[i % 2]}}/{{('en', 'fr')[i % 3 % 2]}}/{{i}}", "h") for i in range(90)],
              "page_id long, url string, html string", "pages")
        import corpus_pipeline
        from plumbline.llm import queries
        for name, query in queries.queries().items():
            print(name, query(spark, sf).count(), flush=True)
        print("pipeline", corpus_pipeline.run(spark, sf).count())
    """))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-P", str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    lines = dict(line.split() for line in done.stdout.splitlines() if line)
    assert len(lines) == 14 and lines["op5_language_id"] == lines["op8_toxicity"] == "120" and int(lines["op3_decontaminate"]) >= 1
    assert int(lines["pipeline"]) > 0
