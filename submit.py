"""Entry file for spark-submit, e.g.

    spark-submit --master yarn --conf spark.checkpoint.dir=hdfs:///shared/ckpt \
        --conf spark.sql.execution.arrow.maxRecordsPerBatch=256 \
        --conf spark.sql.sources.parallelPartitionDiscovery.parallelism=4000 \
        submit.py ingest -g hdfs:///mail/good -b hdfs:///mail/bad -o hdfs:///mail/training.jsonl

The package travels to the executors by value inside the task closures, so no
--py-files archive is needed (adding one does no harm).
"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from mailsift.cli import main  # noqa: E402

if __name__ == "__main__":
    sys.exit(main())
