"""toxscan: toxic-text moderation on Spark DataFrames.

Dataset building, text cleaning, an additive token scorer, attribution and masking ("purify"),
evaluation metrics, vector pooling and URL keys, all expressed with DataFrame / SQL operators.
"""

__version__ = "0.1.0"
