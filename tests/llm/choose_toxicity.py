"""How the settings of the toxicity model are chosen: four folds of the learning rows of a table (crc32 of the id modulo 3
not 1) and no other row. Run: python tests/llm/choose_toxicity.py /root/testdata/sf0.1"""

import itertools
import sys
import zlib
from multiprocessing import Pool
from pathlib import Path

import numpy as np
import pandas as pd

sys.path.insert(0, str(Path(__file__).parents[2]))
from stagesignal.llm import toxicity  # noqa: E402

GRID = list(itertools.product([(), (2, 3, 5, 8)], [0.0, 0.1, 0.2]))


def learning_rows(folder: str) -> pd.DataFrame:
    rows = pd.read_parquet(f"{folder}/documents.parquet", columns=["doc_id", "text"]).merge(pd.read_parquet(f"{folder}/labels.parquet"), on="doc_id")
    rows = rows[rows["toxic"].isin((0, 1)) & (rows["text"].fillna("").str.len() <= 200_000)]
    return rows[[zlib.crc32(str(i).encode()) % 3 != 1 for i in rows["doc_id"]]].reset_index(drop=True)


def tried(job: tuple) -> tuple:
    folder, times, left_out, fold = job
    toxicity.TIMES = times
    rows = learning_rows(folder)
    of = np.array([zlib.crc32(f"fold{i}".encode()) % 4 for i in rows["doc_id"]])
    learn, held = rows[of != fold], rows[of == fold]
    model = toxicity.train(learn["text"].tolist(), learn["toxic"].tolist(), left_out=left_out)
    p, y = np.array([model.score(t) for t in held["text"]]) >= 0.7, held["toxic"].to_numpy() == 1
    return times, left_out, int((y & p).sum()), int(p.sum()), int(y.sum())


if __name__ == "__main__":
    with Pool(8) as pool:
        got = pd.DataFrame(pool.map(tried, [(sys.argv[1], *g, f) for g in GRID for f in range(4)], chunksize=1), columns=["times", "left_out", "right", "called", "toxic"])
    sums = got.groupby(["times", "left_out"]).sum()
    print(sums.assign(precision=sums["right"] / sums["called"], recall=sums["right"] / sums["toxic"]))
