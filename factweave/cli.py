"""Commands over a folder of tables (W-5): python -m factweave.cli COMMAND FOLDER ...

chunk FOLDER [DOCUMENT]        chunks made anew from pages and blocks
candidates FOLDER FACT         the best candidates of a fact
reconcile FOLDER FACT FACT     the comparison of two facts
evaluate                       the scorecard of the demonstration; ends with 1 if a case fails
run FOLDER OUT                 the whole job; what it makes is written to OUT
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import functions as F


def main(args: list[str], spark=None) -> int:
    from factweave import session
    from factweave.operators import chunking, facts as FA, pairs as PR, read as R
    from factweave.plans.pipeline import Job, prepared
    from factweave.sources import demo

    if not args or args[0] not in ("chunk", "candidates", "reconcile", "evaluate", "run"):
        print(__doc__)
        return 2
    command, *rest = args
    spark = spark or session.build("factweave")
    if command == "evaluate":
        rows = demo.scorecard(spark).collect()
        for r in rows:
            print("pass" if r.passed else "FAIL", r.case, r.expected, r.actual, sep="  ")
        return int(not all(r.passed for r in rows))
    folder = rest[0]
    names = [n for n in ("document_files", "pages", "blocks", "chunks", "facts", "entities", "entity_aliases") if os.path.exists(f"{folder}/{n}.parquet") or "://" in folder]
    t = {n: session.table(spark, folder, n) for n in names}
    if command == "chunk":
        c = chunking.chunk_documents(t["pages"] if len(rest) < 2 else t["pages"].where(F.col("document_id") == rest[1]), t["blocks"])
        for r in c.select("document_id", "sequence_index", "start_page", "end_page", "token_count", F.array_join("heading_path", " > ").alias("path")).orderBy("document_id", "sequence_index").toLocalIterator():
            print(*r, sep="  ")
    elif command == "run":
        job = Job(t)
        made = job.run()
        for n in ("chunks", "facts", "normalized", "related"):
            made[n].write.mode("overwrite").parquet(f"{rest[1]}/{n}.parquet")
        for stage, state, seconds, message in job.log:
            print(stage, state, f"{seconds:.1f} s", message or "", sep="  ")
    else:
        f = prepared(t["facts"], t["document_files"], t["entities"], t.get("entity_aliases")) if command == "candidates" else FA.latest(t["facts"], ["id"], F.col("created_at"), F.col("seq"))
        if command == "candidates":
            c = PR.search_candidates(f, t["entities"], f.where(F.col("id") == rest[1]), session.Scratch(spark, "candidates"))
            for r in c.orderBy("rank").select("b_id", "score", F.array_join("reasons", "; ").alias("reasons")).collect():  # the best ten
                print(*r, sep="  ")
        else:
            row = R.reconcile(t | {"facts": f}, *rest[1:3]).select("d.type", "d.dimension", "d.confidence", "explanation").first()
            if row is None:
                print("not found")
                return 1
            print(*row, sep="  ")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
