"""Readers and writers of baskets, itemset supports, rules, histograms and run logs."""
