"""Panel operators: cleaning, indicators, folds, quality control, statistics, signals, fronts, selection."""
