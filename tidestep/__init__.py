"""tidestep: a stepwise dataflow engine whose state is Spark DataFrames."""
