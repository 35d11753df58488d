"""Two-dimensional projection of the feature space by principal components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA, PCAModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame

from winnow.operators.split import frac_sample


def project_2d(
    df: DataFrame, cols: Sequence[str], id_col: str = "id", fit_frac: float = 1.0, seed: int = 0,
    model: PCAModel | None = None, save_to: str | None = None,
) -> tuple[DataFrame, PCAModel]:
    """Columns id, ``0``, ``1``, and the fitted model; a given model is applied, not refitted.

    Each axis points to where its largest loading is positive.
    """
    rows = VectorAssembler(inputCols=list(cols), outputCol="_v").transform(df.select(id_col, *cols))
    if model is None:
        model = PCA(k=2, inputCol="_v", outputCol="_z").fit(frac_sample(rows, fit_frac, seed, id_col))
        if save_to is not None:
            model.write().overwrite().save(save_to)
    z = vector_to_array("_z")
    loadings = model.pc.toArray()  # columns x 2
    signs = [1.0 if max(axis, key=abs) > 0 else -1.0 for axis in loadings.T.tolist()]
    return model.transform(rows).select(id_col, *[(z[i] * signs[i]).alias(str(i)) for i in (0, 1)]), model


def load_projection(path: str) -> PCAModel:
    return PCAModel.load(path)
