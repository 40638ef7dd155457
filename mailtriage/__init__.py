"""mailtriage: a PySpark-native engine for suspicious e-mail and text corpora."""
