"""Small panels with gaps, built from a rule."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd

START = datetime(2024, 1, 1)


def panel(series: int = 2, hours: int = 300, seed: int = 1, gap: float = 0.1) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    frames = []
    for s in range(series):
        n = hours - 20 * s
        t = np.arange(n)
        price = 50 + 20 * np.sin(2 * np.pi * t / 24) + rng.normal(0, 5, n)
        load = np.round(100 + 30 * np.cos(2 * np.pi * t / 24) + rng.normal(0, 3, n))
        frame = pd.DataFrame(
            {
                "series_id": f"s{s}",
                "ts": [START + timedelta(hours=int(h)) for h in t],
                "price": price,
                "load": load,
                "wind": rng.uniform(0, 30, n),
                "solar": rng.uniform(0, 20, n),
                "net_import": rng.normal(0, 10, n),
                "up_reserve": rng.uniform(5, 10, n),
                "down_reserve": rng.uniform(0, 5, n),
                "total_gen": rng.uniform(80, 120, n),
            }
        )
        frames.append(frame[rng.uniform(size=n) >= gap])
    return pd.concat(frames, ignore_index=True)


def spark_panel(spark, pdf: pd.DataFrame):
    columns = ", ".join(f"{c} double" for c in pdf.columns if c not in ("series_id", "ts"))
    return spark.createDataFrame(pdf, f"series_id string, ts timestamp_ntz, {columns}")


def collected(df, *keys):
    return df.toPandas().sort_values(list(keys)).reset_index(drop=True)
