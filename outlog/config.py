"""Default parameters.

Fixed values that must equal the behaviour being reproduced are listed together here, in
their natural order, and passed explicitly to the operators (there is no global state).
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---- fixed values -----------------------------------------------------------------------
# Word2Vec: vector length 25, context window 5, minimum count 1, 5 iterations, seed 1.
# SOM: 24 x 24 map, 100 rough + 5 fine-tune epochs, "pca" initialisation.
# Read windows: train 900 s / 315448 rows, infer 60 s / 78862 rows.
# Anomaly threshold factor 3.1 (threshold = 3.1 * std + mean), 10 inferences per retrain.
# Prediction constants: elast_alert = 1, predictor_namespace = "localhost".
# Feedback: message at most 2000 characters, predict_id / customer_id at most 255.
# Alert rules: frequency = at least 1 event in 2 minutes, realert 10 minutes, 30 minute
#   buffer; flatline = fewer than 1 event in 60 minutes, realert 1 hour.
# Validation data: first 80 % clean; a later row is corrupted when randint(1, 100) >= 90,
#   by round(len * entropy) replacements with chr(randint(65, 123)), entropy 1, seed 42.
W2V_VECTOR_LENGTH = 25
W2V_WINDOW = 5
W2V_MIN_COUNT = 1
W2V_ITER = 5
W2V_SEED = 1
SOM_MAP_SIZE = 24
SOM_ROUGH_EPOCHS = 100
SOM_FINETUNE_EPOCHS = 5
SOM_INIT = "pca"
TRAIN_TIME_SPAN = 900
TRAIN_MAX_ENTRIES = 315448
INFER_TIME_SPAN = 60
INFER_MAX_ENTRIES = 78862
INFER_ANOMALY_THRESHOLD = 3.1
INFER_LOOPS = 10
ELAST_ALERT = 1
PREDICTOR_NAMESPACE = "localhost"
FEEDBACK_MESSAGE_MAX = 2000
FEEDBACK_ID_MAX = 255
FREQUENCY_NUM_EVENTS = 1
FREQUENCY_TIMEFRAME_S = 120
FREQUENCY_REALERT_S = 600
ALERT_BUFFER_S = 1800
FLATLINE_THRESHOLD = 1
FLATLINE_TIMEFRAME_S = 3600
FLATLINE_REALERT_S = 3600
VALIDATION_TRAIN_SHARE = 0.80
VALIDATION_GATE = 90
VALIDATION_CHAR_LOW = 65
VALIDATION_CHAR_HIGH = 123
VALIDATION_ENTROPY = 1.0
VALIDATION_SEED = 42
# -----------------------------------------------------------------------------------------

# Limits we choose for Spark (not part of the reproduced behaviour).
BROADCAST_MAX_BYTES = 64 * 1024 * 1024   # largest model/lookup we ship to every executor
W2V_PARTITIONS = 8                       # Word2Vec training tasks: a fixed number, whatever the corpus
SCORE_CHUNK_ROWS = 4096                  # rows per numpy distance block inside a task


@dataclass
class DetectorConfig:
    """Parameters of one train/predict pipeline (replaces the environment loader)."""

    vector_length: int = W2V_VECTOR_LENGTH
    window: int = W2V_WINDOW
    min_count: int = W2V_MIN_COUNT
    w2v_iter: int = W2V_ITER
    w2v_seed: int = W2V_SEED
    w2v_partitions: int = W2V_PARTITIONS
    max_sentence_length: int = 1000
    map_rows: int = SOM_MAP_SIZE
    map_cols: int = SOM_MAP_SIZE
    epochs: int = SOM_ROUGH_EPOCHS + SOM_FINETUNE_EPOCHS
    som_init: str = SOM_INIT
    threshold_factor: float = INFER_ANOMALY_THRESHOLD
    elast_alert: int = ELAST_ALERT
    namespace: str = PREDICTOR_NAMESPACE
    oov: str = "hash"
    model_version: str = "v1"
    extra: dict = field(default_factory=dict)
