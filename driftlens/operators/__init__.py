"""DataFrame -> DataFrame operators. The fits (split plan, Naive Bayes, MLlib) and Naive
Bayes scoring run jobs when they are called; all others only build a plan."""
