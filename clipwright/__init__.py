"""Caption quality jobs on Spark: tasks, frames, descriptions, candidates and judge replies as DataFrames."""
