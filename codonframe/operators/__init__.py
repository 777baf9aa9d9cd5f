"""DataFrame operators. Some measure an annotation or look at lengths by a small query before they return their plan."""
