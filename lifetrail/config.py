"""Parameters and session helpers.

All thresholds the analyses use are arguments (``Params``).  The
defaults fit the provided test tables (orders 1995-2001); ``Params.reference()``
returns the values of the original card-transaction study.
"""

from __future__ import annotations

import os
import tempfile
from dataclasses import dataclass, replace

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Params:
    # ---- data window -------------------------------------------------
    last_year_excl: int = 2001          # keep tx_year < this (partial last year)
    as_of_year: int = 2000              # recency anchor (last complete year)
    min_cohort: int = 1996              # cohort filter, applied after the per-user minimum
    # ---- amount rules --------------------------------------------------
    outlier_cap: int = 100_000          # monetary view keeps 0 < amount <= cap
    outlier_band_low: int = 50_000      # outlier report bands
    outlier_band_high: int = 100_000
    high_value: int = 2_000_000         # revenue_summary high-value user threshold
    # ---- lifecycle -----------------------------------------------------
    activation_window: int = 30
    window_mode: str = "date_int"       # 'date_int' (YYYYMMDD subtraction) | 'calendar' (datediff)
    age_min: int = 1                    # complete-years export window
    age_max: int = 17
    profile_cohort_lo: int = 1995       # cohort_demographics range
    profile_cohort_hi: int = 1998
    # ---- ranking / segmentation ---------------------------------------
    top_k: int = 20
    top_per_segment: int = 7
    n_bins: int = 5
    hist_bins: int = 50
    recency_bands: tuple = (0, 2, 5, 9)     # R = 5,4,3,2 at <= each band, else 1
    segment_cuts: tuple = (13, 10, 7)       # VIP, Loyal, Potential score floors
    # ---- experiment ----------------------------------------------------
    n_per_group: int | None = None      # users per arm; None: half of all users
    alpha: float = 0.05
    power: float = 0.80
    seed: int = 42
    planned_mde: float = 0.09
    mde_grid: tuple = (0.05, 0.07, 0.09, 0.11, 0.13, 0.15)
    power_n_lo: int = 50
    power_n_hi: int = 990
    power_n_step: int = 10
    default_segment: str = "Potential"

    @property
    def last_kept_year(self) -> int:
        return self.last_year_excl - 1

    @property
    def lifespan_cohort_hi(self) -> int:
        # cohorts with at least one year of possible follow-up
        return self.last_kept_year - 1

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)

    @classmethod
    def reference(cls) -> "Params":
        """Values used by the original study (card data 1991-2020)."""
        return cls(last_year_excl=2020, as_of_year=2019, min_cohort=2002,
                   outlier_cap=5000, outlier_band_low=5000, outlier_band_high=10000,
                   high_value=10000, n_per_group=316, profile_cohort_lo=2009, profile_cohort_hi=2014)


def get_session(app: str = "lifetrail", cores: int | str = "*", shuffle_partitions: int = 8,
                extra: dict | None = None) -> SparkSession:
    """Local session for tests and benches.  On a cluster, pass the
    cluster's own session to the operators instead."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.driver.memory", "16g"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder named by the session.

    A cluster names a shared folder in ``spark.checkpoint.dir``; we read
    it and never override it.  Where it is unset, a local session (tests)
    gets a private scratch folder; a cluster session raises, since its
    executors could not see each other's files there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="lifetrail-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return conf_dir


#: Most shuffle partitions: map tasks times reduce tasks is what the driver tracks.
MOST_SHUFFLE_PARTITIONS = 20_000


def cluster_settings(input_bytes: int, total_cores: int, reduction: float = 0.05, target_partition_bytes: int = 512 << 20) -> dict:
    """Session settings for a cluster run over ``input_bytes`` of input.

    * file splits large enough that scans have at most some tens of
      thousands of tasks;
    * shuffle partitions sized by what is shuffled: the analyses reduce the
      fact before the exchange, so ``reduction`` times the input, at least
      two per core and within ``MOST_SHUFFLE_PARTITIONS``; AQE coalesces
      small ones and splits skewed ones;
    * skew-join handling on, with the threshold at the partition target."""
    shuffled = int(input_bytes * reduction)
    parts = min(MOST_SHUFFLE_PARTITIONS, max(2 * total_cores, -(-shuffled // target_partition_bytes)))
    split = max(target_partition_bytes, min(4 << 30, int(input_bytes) // 100_000))
    size = f"{target_partition_bytes >> 20}m"
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": size,
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": size,
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": f"{split >> 20}m",
        "spark.sql.session.timeZone": "UTC",
    }
