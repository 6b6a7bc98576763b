"""Models: trees, boosted chains and k-means. Training is a driver loop over DataFrame plans, prediction is a column or a broadcast join."""
