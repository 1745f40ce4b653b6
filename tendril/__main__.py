from tendril.jobs import main

main()
