"""A PySpark engine for conversational archives, knowledge graphs and training corpora."""
