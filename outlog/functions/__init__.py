"""Column functions: text cleaning, encodings, ids and vector maths."""
from .text import (template, common_log_message, common_log_token, strip_prefix, to_str,
                   fill_empty, percent_encode, parse_bool, clean_whitespace)
from .ids import stable_id, seeded_unit, seeded_int
from .vectors import (as_double_array, euclidean, squared_distance, cosine_distance, dot, norm,
                      concat_vectors, learning_rate, neighbourhood, grid_distance, hash_vector,
                      hash_unit, zeros)
