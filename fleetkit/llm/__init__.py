"""Training-data operators: thirteen corpus jobs and the pipeline that chains five of them."""
