"""meshfold: graph analytics and full-batch graph-network training on PySpark DataFrames."""
