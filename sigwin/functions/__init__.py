from sigwin.functions.columns import (
    all_finite, binarise, coerce_numeric, contig_key, ensemble_mean, focal_loss_terms,
    is_drach, is_finite, nan_to_null, predicted_class, round_doubles, shuffle_key, softmax2,
)

__all__ = [
    "all_finite", "binarise", "coerce_numeric", "contig_key", "ensemble_mean",
    "focal_loss_terms", "is_drach", "is_finite", "nan_to_null", "predicted_class", "round_doubles",
    "shuffle_key", "softmax2",
]
