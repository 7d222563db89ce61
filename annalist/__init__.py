"""Knowledge analytics over software repositories, declared as Spark DataFrames."""
