"""courier: delivery, audit and preparation of record streams, as DataFrames."""
