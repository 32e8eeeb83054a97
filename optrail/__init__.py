"""optrail: availability-aware process analytics on Spark DataFrames."""
